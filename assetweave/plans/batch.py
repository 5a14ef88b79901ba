"""The whole flow as one declarative plan: clean, classify, learn, resolve, harvest, link."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.operators import classify, cleaning, filters, learning, linking, ranking, reports, resolve, web

STAGES = ("clean", "classify", "learn", "resolve", "harvest", "link")


@dataclass
class Inputs:
    """items(item_id, item_code, description, supplier[, category]), master(supplier, website),
    dictionary(category, keyword), docs(doc_id, supplier, file_name, text), and optionally
    hits(supplier, engine, pos, url), pages(page_id, url, html), state(supplier, last_seen), have(supplier, file_name),
    found(supplier, url, size_bytes) and aliases(supplier, folder)."""

    items: DataFrame
    master: DataFrame
    dictionary: DataFrame
    docs: DataFrame
    hits: DataFrame | None = None
    pages: DataFrame | None = None
    state: DataFrame | None = None
    have: DataFrame | None = None
    found: DataFrame | None = None
    aliases: DataFrame | None = None
    engines: tuple[str, str] = ("first", "second")


@dataclass
class Settings:
    stages: tuple[str, ...] = STAGES
    min_occurrences: float = rules.MIN_OCCURRENCES
    confidence: int = rules.AUTO_ADD_CONFIDENCE
    threshold: float = rules.LINK_THRESHOLD
    score: linking.Score = linking.NAMED
    item_wise: bool = False  # aliases, matched supplier names, and all documents for items without a folder
    now: datetime | None = None  # harvest: when sites count as due
    max_depth: int = 2
    prioritize: bool = False


def run(inputs: Inputs, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Results by name. Linking and entity matching write intermediate tables while the plan is built; every
    result is computed when it is written or counted."""
    unknown = set(settings.stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    on, out, items = set(settings.stages), {}, inputs.items
    if "clean" in on:
        out["clean_diff"] = cleaning.clean_diff(items, "supplier", "item_id")
        items = cleaning.clean(items, "supplier")
    if "classify" in on:
        items = classify.classify(items, "description", "supplier", out="item_type")
        out["labels"] = classify.label_counts(items, "item_type")
    out["items"] = items
    if {"classify", "learn"} <= on:
        candidates = learning.learn_candidates(items, "description", "item_type", inputs.dictionary)
        decisions = learning.promote(candidates, inputs.dictionary, settings.min_occurrences)
        out.update(candidates=candidates, decisions=decisions,
                   dictionary=learning.updated_dictionary(inputs.dictionary, decisions))
    if "resolve" in on:
        known, open_ = resolve.split_known(resolve.distinct_suppliers(items, "supplier"), inputs.master)
        out["known"] = resolved = known
        if inputs.hits is not None:
            routed = resolve.route_by_confidence(
                resolve.pick_best_url(open_, inputs.hits, inputs.engines), settings.confidence)
            out["routed"], resolved = routed, resolve.union_sources(known, routed)
        out["resolved"] = resolved
    if "harvest" in on and inputs.pages is not None:
        out["links"] = web.extract_links(inputs.pages)
        if "resolve" in on:
            out.update(harvest(inputs, settings, out["resolved"], out["links"]))
    if "link" in on:
        kept = filters.exclude_types(items, "item_type") if "classify" in on else items
        docs = inputs.docs
        if settings.prioritize:
            chosen = ranking.prioritize(docs.select("doc_id", "supplier", "file_name"))
            docs = docs.join(chosen.select("doc_id"), "doc_id", "left_semi")
        if settings.item_wise:
            links = linking.link_items(kept, docs, settings.threshold, aliases=inputs.aliases).drop("file_name")
        else:
            links = linking.link(kept, docs, settings.threshold, settings.score)
        named = links.join(inputs.docs.select("doc_id", "supplier", "file_name"), "doc_id")
        out.update(links_scored=named, summary=reports.match_summary(kept, named),
                   vendors=reports.vendor_match_stats(named))
    return out


def harvest(inputs: Inputs, settings: Settings, resolved: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Sites of resolved suppliers that are due, the pages and documents reached from them, and the downloads to keep."""
    sites = resolved.filter(F.coalesce("website", F.lit("")) != "").select("supplier", "website").distinct()
    if inputs.state is not None:
        now = F.lit(settings.now).cast("timestamp") if settings.now else F.current_timestamp()
        sites = filters.due_for_rescan(sites, inputs.state, now)
    visited = web.reachable(links, sites.select(F.col("supplier").alias("site"), F.col("website").alias("url")), settings.max_depth)
    found = web.site_documents(visited, links)
    out = {"due": sites, "visited": visited, "found": found, "sites": web.site_summary(visited, found)}
    if inputs.found is not None:
        have = inputs.have if inputs.have is not None else inputs.found.select("supplier", F.lit("").alias("file_name")).limit(0)
        wanted = inputs.found.join(found.select(F.col("site").alias("supplier"), "url"), ["supplier", "url"], "left_semi")
        out["downloads"] = filters.download_gate(wanted, have)
    return out
