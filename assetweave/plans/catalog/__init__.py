"""Registered queries: every operator bound to the supplied tables, with its reference SQL."""

from assetweave.plans.catalog.registry import oracle_sql, queries
from assetweave.plans.catalog import documents, labels, links, pages, quality, reporting, storage, streams, suppliers

__all__ = ["queries", "oracle_sql", "documents", "labels", "links", "pages", "quality", "reporting",
           "storage", "streams", "suppliers"]
