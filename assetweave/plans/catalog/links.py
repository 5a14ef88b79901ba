"""Linking items to documents, and what is reported about the links."""

from pyspark.sql import functions as F

from assetweave.operators import filters, linking, ranking, reports
from assetweave import rules
from assetweave.plans.catalog.documents import _CATEGORY_OF, _NORMAL, _model, _pieces, FULL, SHORT, WIDE, prioritized
from assetweave.plans.catalog.registry import (
    ITEMS_SQL, LIBRARY_SQL, WORD, any_of, items, library, query, role, table, trimmed)

MIN_COVERAGE = 0.6


def plain_items(spark, sf_dir):
    return items(spark, sf_dir).drop("category")


PLAIN_ITEMS_SQL = ITEMS_SQL.replace("SELECT", "SELECT * REPLACE ('' AS category) FROM (SELECT", 1)[:-1] + "))"
COVERED = f"""kw AS (SELECT item_id, supplier, description, {SHORT} AS kw FROM items), hit AS (SELECT item_id, doc_id,
 CAST(len([k FOR k IN kw IF contains(lower(text), k)]) AS INTEGER) AS hits, CAST(len(kw) AS INTEGER) AS n_keywords FROM kw, library),
 links AS (SELECT *, hits::DOUBLE / n_keywords AS coverage FROM hit WHERE hits >= ceil({MIN_COVERAGE} * n_keywords - 1e-9))"""


def covered(spark, sf_dir):
    docs = library(spark, sf_dir).select("doc_id", "text")
    return linking.coverage_links(plain_items(spark, sf_dir), docs, MIN_COVERAGE)


@query(f"""WITH {PLAIN_ITEMS_SQL}, {LIBRARY_SQL}, {COVERED} SELECT item_id, doc_id, hits, n_keywords, round(coverage, 6) AS coverage FROM links""")
def coverage_links(spark, sf_dir):
    return covered(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {PLAIN_ITEMS_SQL}, {LIBRARY_SQL}, {COVERED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, doc_id) AS k,
 count(*) OVER (PARTITION BY item_id) AS n_docs FROM links) SELECT item_id, doc_id, round(coverage, 6) AS coverage, n_docs FROM r WHERE k = 1""")
def best_document(spark, sf_dir):
    """Flagship: keywords, exact blocking, coverage, best document per item."""
    return linking.best_link(covered(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {ITEMS_SQL}, {LIBRARY_SQL}, kw AS (SELECT item_id, {FULL} AS kw FROM items), hit AS (SELECT item_id, doc_id,
 CAST(len([k FOR k IN kw IF contains(lower(text), k)]) AS INTEGER) AS hits, CAST(len(kw) AS INTEGER) AS n_keywords FROM kw, library)
 SELECT item_id, doc_id, hits, n_keywords FROM hit WHERE hits >= ceil(0.5 * n_keywords - 1e-9)""")
def coverage_links_full(spark, sf_dir):
    return linking.coverage_links(items(spark, sf_dir), library(spark, sf_dir), 0.5, "full") \
        .select("item_id", "doc_id", "hits", "n_keywords")


# What decides about a link up to the similarity ratio, which has no SQL form: hits, coverage, name parts and the ratio's
# bound. The links themselves are checked against brute force in the tests.

def _bounds(kw: str, score: str, threshold: int, where: str = "true") -> str:
    return f"""WITH {PLAIN_ITEMS_SQL}, {LIBRARY_SQL}, kws AS (SELECT item_id, supplier, lower(description) AS low, {kw} AS kw FROM items),
 p AS (SELECT item_id, doc_id, file_name, lower(file_name) AS name, low, lower(text) AS doc, len(kw) AS n, len([k FOR k IN kw IF contains(lower(text), k)]) AS hits,
  2.0::DOUBLE * least(length(low), length(lower(text))) / (length(low) + length(lower(text))) AS ratio
  FROM kws i, library l WHERE len(kw) > 0 AND length(text) > 0 AND {where}),
 b AS (SELECT item_id, doc_id, CAST(hits AS INTEGER) AS hits, hits::DOUBLE / n AS coverage, {score} AS bound FROM p)
 SELECT item_id, doc_id, hits, round(coverage, 6) AS coverage, round(bound, 4) AS bound FROM b WHERE bound >= {threshold} - 1e-9"""


def _bound_rows(links):
    return links.select("item_id", "doc_id", "hits", F.round("coverage", 6).alias("coverage"), F.round("bound", 4).alias("bound"))


_SAID = f"regexp_extract_all(low, '{WORD}')"
_NAME_PART = f"coalesce(15.0::DOUBLE * len([w FOR w IN {_SAID} IF length(w) > 3 AND contains(name, w)]) / nullif(len({_SAID}), 0), 0)"
_NAMED_BOUND = f"""least(100.0, greatest(0.0, hits * 60.0::DOUBLE / n + 25 * ratio + {_NAME_PART}
 - CASE WHEN {any_of('name', rules.MARKETING_NAME_PARTS)} THEN 15 ELSE 0 END)
 + CASE WHEN {any_of('name', rules.TECHNICAL_NAME_PARTS)} THEN 10 ELSE 0 END)"""


@query(_bounds(SHORT, _NAMED_BOUND, 60, "i.supplier = l.supplier"))
def link_bounds_by_supplier(spark, sf_dir):
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 60))


@query(_bounds(SHORT, "least(hits * 70.0::DOUBLE / n + 30 * ratio, 100)", 60))
def link_bounds_all_documents(spark, sf_dir):
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 60, linking.PLAIN, by=None))


@query(_bounds(SHORT, _NAMED_BOUND, 40, "i.supplier = l.supplier"))
def link_bounds_below_floor(spark, sf_dir):
    """A threshold that lengths and names reach without any keyword."""
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 40))


_POINTS = "CASE " + " ".join(f"WHEN {_CATEGORY_OF} = '{label}' THEN {points}" for label, points in rules.PRIORITY_BOOST.items()) + " ELSE 0 END"


@query(_bounds(SHORT, f"least(100, least(100, hits * 70.0::DOUBLE / n + 30 * ratio) + {_POINTS})", 60))
def link_bounds_boosted(spark, sf_dir):
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 60, linking.BOOSTED, by=None))


_SIGNALS = f"""hits * 40.0::DOUBLE / n + 30 * ratio
 + 20.0::DOUBLE * coalesce(len(list_intersect(list_distinct({_model('low')}), {_model('doc')}))::DOUBLE / nullif(len({_model('low')}), 0), 0)
 + 10.0::DOUBLE * coalesce(len(list_intersect({_pieces('low')}, {_pieces('doc')}))::DOUBLE / nullif(len({_pieces('low')}), 0), 0)"""
_PHRASE = f"len([p FOR p IN string_split(low, ',') IF length({trimmed('p')}) > 5 AND contains(doc, {trimmed('p')})]) > 0"


@query(_bounds(FULL, f"least(({_SIGNALS}) * CASE WHEN {_PHRASE} THEN 1.3::DOUBLE ELSE 1 END, 100)", 85))
def link_bounds_four_signal(spark, sf_dir):
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 85, linking.FOUR_SIGNAL, by=None))


@query(_bounds(WIDE, "least(hits * 50.0::DOUBLE / n + 50 * ratio, 100)", 55))
def link_bounds_even(spark, sf_dir):
    return _bound_rows(linking.link_bounds(plain_items(spark, sf_dir), library(spark, sf_dir), 55, linking.EVEN, by=None))


# suppliers of items as they are written: as listed, in capitals with an ending, under an alias, and unknown ones
ROUTED = """SELECT item_id, text AS description, CASE item_id % 4 WHEN 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR(9))
  WHEN 1 THEN 'SRC1' || CAST(item_id % 10 AS VARCHAR(9)) || ' holdings' WHEN 2 THEN 'House ' || CAST(item_id % 20 AS VARCHAR(9))
  ELSE 'nowhere' END AS supplier FROM benchmark """
HOUSES = """SELECT DISTINCT 'House ' || CAST(item_id % 20 AS VARCHAR(9)) AS supplier, 'src' || CAST(item_id % 20 AS VARCHAR(9)) AS folder FROM benchmark """


@query(f"""WITH i AS ({ROUTED}), h AS ({HOUSES}), f AS (SELECT DISTINCT source AS target FROM documents),
 s AS (SELECT item_id, lower(coalesce(folder, i.supplier)) AS name FROM i LEFT JOIN h USING (supplier)),
 m AS (SELECT item_id, target, CASE WHEN name = lower(target) THEN 1 WHEN contains(name, lower(target)) OR contains(lower(target), name) THEN 2 END AS k FROM s, f),
 b AS (SELECT item_id, min(k) AS k FROM m WHERE k IS NOT NULL GROUP BY item_id),
 r AS (SELECT item_id, k, min(target) AS folder FROM m JOIN b USING (item_id, k) GROUP BY item_id, k)
 SELECT i.item_id, folder, CASE k WHEN 1 THEN 'exact' WHEN 2 THEN 'containment' END AS strategy FROM i LEFT JOIN r USING (item_id)""")
def route_items(spark, sf_dir):
    """Which items go to which folder, and which fall back to all documents."""
    routed = linking.route_items(role(spark, sf_dir, ROUTED, "benchmark"), library(spark, sf_dir), role(spark, sf_dir, HOUSES, "benchmark"))
    return routed.select("item_id", "folder", "strategy")


@query()
def link_items(spark, sf_dir):
    """The item-wise flow with aliases, fallback and one match per folded file name."""
    found = linking.link_items(role(spark, sf_dir, ROUTED, "benchmark"), library(spark, sf_dir), 50,
                               aliases=role(spark, sf_dir, HOUSES, "benchmark"))
    return found.select("item_id", "doc_id", "file_key", F.round("score", 6).alias("score"), "fallback")



def _rounded(links):
    return links.select("item_id", "doc_id", "hits", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query()
def link_by_supplier(spark, sf_dir):
    return _rounded(linking.link(plain_items(spark, sf_dir), library(spark, sf_dir), 40))


@query()
def link_prioritized(spark, sf_dir):
    chosen = prioritized(spark, sf_dir).select("doc_id")
    docs = library(spark, sf_dir).join(chosen, "doc_id", "left_semi")
    return _rounded(linking.link(plain_items(spark, sf_dir), docs, 30))


@query()
def link_all_documents(spark, sf_dir):
    return _rounded(linking.link(plain_items(spark, sf_dir), library(spark, sf_dir), 60, by=None))


@query()
def link_boosted(spark, sf_dir):
    return _rounded(linking.link(plain_items(spark, sf_dir), library(spark, sf_dir), 60, linking.BOOSTED, by=None))


@query()
def link_master_folders(spark, sf_dir):
    """Folders that the item list names, some of them under an alias."""
    master = role(spark, sf_dir, ROUTED, "benchmark").select(F.lower("supplier").alias("supplier"))
    aliases = role(spark, sf_dir, HOUSES, "benchmark").withColumn("supplier", F.lower("supplier"))
    return _rounded(linking.link_master_folders(plain_items(spark, sf_dir), library(spark, sf_dir), master, aliases=aliases))


@query()
def link_four_signal(spark, sf_dir):
    return _rounded(linking.link(plain_items(spark, sf_dir), library(spark, sf_dir), 85, linking.FOUR_SIGNAL, by=None))


@query()
def link_even(spark, sf_dir):
    return _rounded(linking.link(plain_items(spark, sf_dir), library(spark, sf_dir), 55, linking.EVEN, by=None))


# --- reports, on the coverage links scored in percent ---------------------------------------------

MATCHES = f"""{PLAIN_ITEMS_SQL}, {LIBRARY_SQL}, {COVERED}, matches AS (SELECT item_id, doc_id, library.supplier, file_name,
 round(coverage * 100, 6) AS score, text FROM links JOIN library USING (doc_id))"""


def matches(spark, sf_dir, *extra):
    docs = library(spark, sf_dir).select("doc_id", "supplier", "file_name", *extra)
    return covered(spark, sf_dir).select("item_id", "doc_id", F.round(F.col("coverage") * 100, 6).alias("score")).join(docs, "doc_id")


def previewed_matches(spark, sf_dir):
    """Matches with `text_preview`, made where documents are read, so that no text moves with a match."""
    return matches(spark, sf_dir, reports.detail_preview(F.col("text")).alias("text_preview"))


SUMMARY = """summary AS (SELECT count(*) AS items, count(n) AS with_match, count(*) - count(n) AS without_match,
 CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, coalesce(sum(n), 0)::DOUBLE / count(*) AS avg_per_item, count(n) * 100.0::DOUBLE / count(*) AS match_rate
 FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM matches GROUP BY item_id) USING (item_id))"""


@query(f"""WITH {MATCHES}, {SUMMARY} SELECT items, with_match, without_match, matches, round(avg_per_item, 6) AS avg_per_item,
 round(match_rate, 6) AS match_rate FROM summary""")
def match_summary(spark, sf_dir):
    out = reports.match_summary(plain_items(spark, sf_dir), matches(spark, sf_dir))
    return out.withColumn("avg_per_item", F.round("avg_per_item", 6)).withColumn("match_rate", F.round("match_rate", 6))


@query(f"""WITH {MATCHES} SELECT supplier, count(*) AS matches, round(avg(score), 4) AS avg_score, max(score) AS max_score,
 min(score) AS min_score FROM matches GROUP BY supplier""")
def vendor_match_stats(spark, sf_dir):
    return reports.vendor_match_stats(matches(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 4))


@query(f"""WITH {MATCHES}, b AS (SELECT unnest(['90-100', '80-89', '70-79', '60-69', '<60']) AS bucket), c AS (SELECT CASE WHEN score >= 90
 THEN '90-100' WHEN score >= 80 THEN '80-89' WHEN score >= 70 THEN '70-79' WHEN score >= 60 THEN '60-69' ELSE '<60' END AS bucket,
 count(*) AS n FROM matches GROUP BY 1) SELECT bucket, coalesce(n, 0) AS matches FROM b LEFT JOIN c USING (bucket)""")
def score_histogram(spark, sf_dir):
    return reports.score_histogram(matches(spark, sf_dir))


@query(f"""WITH {MATCHES} SELECT round(coalesce(avg(score), 0), 4) AS average_score, coalesce(max(score), 0) AS highest_score,
 coalesce(min(score), 0) AS lowest_score FROM matches""")
def score_range(spark, sf_dir):
    return reports.score_range(matches(spark, sf_dir)).withColumn("average_score", F.round("average_score", 4))


@query(f"""WITH {MATCHES}, {SUMMARY}, a AS (SELECT coalesce(avg(score), 0) AS average FROM matches)
 SELECT 'low_match_rate' AS code FROM summary WHERE match_rate < 50 UNION ALL
 SELECT 'low_average_score' FROM a WHERE average < 70 UNION ALL
 SELECT 'few_matches_per_item' FROM summary WHERE items > 100 AND avg_per_item < 1""")
def recommendations(spark, sf_dir):
    found = matches(spark, sf_dir)
    return reports.recommendations(reports.match_summary(plain_items(spark, sf_dir), found), reports.score_range(found)).select("code")


@query(f"""WITH {MATCHES} SELECT item_id, CASE WHEN matches.item_id IS NULL THEN 'No matches' ELSE matches.supplier END AS supplier,
 coalesce(file_name, '') AS file_name, coalesce(round_even(score, 1), 0)::DOUBLE AS score,
 coalesce(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, '') AS text_preview FROM items LEFT JOIN matches USING (item_id)"""
       .replace("matches.item_id IS NULL", "matches.doc_id IS NULL"))
def match_detail(spark, sf_dir):
    detail = reports.match_detail(plain_items(spark, sf_dir), previewed_matches(spark, sf_dir))
    return ranking.sort_matches(detail, "item_id", "file_name").drop("description")


@query(f"""WITH {MATCHES}, k AS (SELECT item_id, {_NORMAL} AS file_key, score, file_name, doc_id FROM matches),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id, file_key ORDER BY score DESC, file_name, doc_id) AS n FROM k)
 SELECT item_id, file_key, score, file_name, doc_id FROM r WHERE n = 1""")
def dedup_matches(spark, sf_dir):
    found = matches(spark, sf_dir).select("item_id", "doc_id", "score", "file_name")
    return ranking.dedup_matches(found).select("item_id", "file_key", "score", "file_name", "doc_id")


@query(f"""WITH {MATCHES}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id, doc_id) AS number, count(*) OVER () AS total FROM matches)
 SELECT item_id, doc_id, number, 'PDF ' || number || '/' || total || ': ' || file_name || ' (Score: ' || printf('%.1f', score) || '%)' AS result FROM n""")
def number_matches(spark, sf_dir):
    found = matches(spark, sf_dir)
    return ranking.number_matches(found, F.desc("score"), "item_id", "doc_id").select("item_id", "doc_id", "number", "result")


@query(f"""WITH {PLAIN_ITEMS_SQL}, {LIBRARY_SQL}, {COVERED} SELECT item_id, doc_id, hits FROM links WHERE coverage >= 0.9""")
def threshold_links(spark, sf_dir):
    return filters.at_least(covered(spark, sf_dir), 0.9, "coverage").select("item_id", "doc_id", "hits")


TYPED = """typed AS (SELECT *, CASE item_id % 4 WHEN 0 THEN 'Software' WHEN 1 THEN 'Non-Instrument' WHEN 2 THEN 'Instrument' ELSE '' END AS item_type FROM items)"""
PER = """per AS (SELECT f.supplier, (SELECT count(*) FROM typed i WHERE i.supplier = f.supplier) AS items,
 (SELECT count(*) FROM typed i WHERE i.supplier = f.supplier AND item_type NOT IN ('Software', 'Non-Instrument')) AS kept,
 (SELECT count(*) FROM matches m JOIN typed i USING (item_id) WHERE i.supplier = f.supplier AND m.supplier = f.supplier
  AND item_type NOT IN ('Software', 'Non-Instrument')) AS matches FROM (SELECT DISTINCT supplier FROM library) f)"""


def per_supplier(spark, sf_dir):
    typed = plain_items(spark, sf_dir).withColumn("item_type", F.expr(
        "CASE item_id % 4 WHEN 0 THEN 'Software' WHEN 1 THEN 'Non-Instrument' WHEN 2 THEN 'Instrument' ELSE '' END"))
    kept = filters.exclude_types(typed, "item_type")
    found = matches(spark, sf_dir).join(kept.select("item_id", "supplier"), ["item_id", "supplier"], "left_semi")
    folders = table(spark, sf_dir, "documents").select(F.col("source").alias("supplier"))
    return reports.supplier_run_stats(folders, typed, kept, found)


@query(f"""WITH {MATCHES}, {TYPED}, {PER} SELECT supplier, items, kept, items - kept AS skipped, matches FROM per""")
def supplier_run_stats(spark, sf_dir):
    return per_supplier(spark, sf_dir)


@query(f"""WITH {MATCHES}, {TYPED}, {PER} SELECT count(*) AS suppliers, count(*) FILTER (WHERE matches > 0) AS suppliers_with_matches,
 CAST(sum(kept) AS BIGINT) AS items_kept, CAST(sum(items - kept) AS BIGINT) AS items_skipped, CAST(sum(matches) AS BIGINT) AS matches,
 round(100.0 * count(*) FILTER (WHERE matches > 0) / count(*), 6) AS supplier_match_rate,
 round(coalesce(100.0 * sum(matches) / nullif(sum(kept), 0), 0), 6) AS item_match_rate FROM per""")
def run_totals(spark, sf_dir):
    out = reports.run_totals(per_supplier(spark, sf_dir))
    return out.withColumn("supplier_match_rate", F.round("supplier_match_rate", 6)).withColumn("item_match_rate", F.round("item_match_rate", 6))
