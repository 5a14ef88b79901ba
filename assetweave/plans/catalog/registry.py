"""Registration of queries and their SQL, and the roles the supplied tables play.

Role tables are given once as SQL text. Spark and the checking engine both evaluate that
text, apart from the few function names that differ; the operators under test are not
part of it.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same text in two dialects ---------------------------------------------------------

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
WORD = r"[\p{L}\p{N}_]+"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '^(.*[^.].*)\.[^.]*$', '\1')"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def in_list(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


# --- roles ------------------------------------------------------------------------------------

LIBRARY_COLUMNS = """
 doc_id, source AS supplier,
 source || '_' || (CASE doc_id % 12
   WHEN 0 THEN 'user_manual' WHEN 1 THEN 'spec sheet' WHEN 2 THEN 'brochure' WHEN 3 THEN 'report'
   WHEN 4 THEN 'installation-guide' WHEN 5 THEN 'datasheet' WHEN 6 THEN 'price list'
   WHEN 7 THEN 'technical data' WHEN 8 THEN 'notes' WHEN 9 THEN 'product info'
   WHEN 10 THEN 'handbook' ELSE 'novaseq app-note' END)
 || (CASE WHEN doc_id % 5 < 2 THEN '_v' || CAST(doc_id % 3 AS VARCHAR(9)) ELSE '' END)
 || (CASE WHEN doc_id % 7 < 3 THEN '_' || CAST(2018 + doc_id % 8 AS VARCHAR(9)) ELSE '' END)
 || (CASE doc_id % 4 WHEN 0 THEN '_final' WHEN 1 THEN ' (2)' ELSE '' END) || '.pdf' AS file_name,
 n_chars * n_chars AS size_bytes, text"""

ITEM_COLUMNS = """
 item_id, 'IT-' || CAST(item_id AS VARCHAR(20)) AS item_code, text AS description,
 'src' || CAST(item_id % 20 AS VARCHAR(9)) AS supplier,
 CASE WHEN item_id % 3 = 0 THEN 'Lab Tools' WHEN item_id % 3 = 1 THEN 'the-tion' ELSE '' END AS category"""

LIBRARY_SQL = f"""library AS (SELECT {LIBRARY_COLUMNS},
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 20000 AS INTEGER)) AS modified FROM documents)"""
ITEMS_SQL = f"items AS (SELECT {ITEM_COLUMNS} FROM benchmark)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"""SELECT {LIBRARY_COLUMNS},
        timestamp_seconds(1704067200 + (doc_id % 20000) * 3600) AS modified FROM {{documents}}""",
                     documents=table(spark, sf_dir, "documents"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {ITEM_COLUMNS} FROM {{benchmark}}", benchmark=table(spark, sf_dir, "benchmark"))


def bind(spark: SparkSession, select: str, **frames: DataFrame) -> DataFrame:
    """SQL text over named DataFrames, batch or streaming."""
    for name in frames:
        select = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", select)
    return spark.sql(select, **frames)


def role(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """A role table from SQL text over the supplied tables."""
    return bind(spark, select, **{name: table(spark, sf_dir, name) for name in tables})
