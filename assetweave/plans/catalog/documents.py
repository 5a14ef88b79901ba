"""Text signals, document names and priorities."""

from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import names, text
from assetweave.operators import linking, ranking, reports
from assetweave.plans.catalog.registry import (
    ITEMS_SQL, LIBRARY_SQL, SPACE, WORD, any_of, in_list, items, library, query, stem, table, trimmed)
from assetweave.session import task_count

# --- keywords and signals ---------------------------------------------------------------------


def _words(x: str, stop: list[str], n: int) -> str:
    return f"[w FOR w IN regexp_extract_all(lower({x}), '{WORD}') IF length(w) >= {n} AND w NOT IN {in_list(stop)}]"


_CATEGORY = f"[w FOR w IN regexp_split_to_array(lower(category), '{SPACE}+') IF w <> '']"


def _capped(xs: str) -> str:
    # longest first, ties alphabetical: pad the inverted length in front and sort as text
    keyed = f"list_sort([lpad(CAST(100000 - length(w) AS VARCHAR), 6, '0') || w FOR w IN list_distinct({xs})])"
    return (f"CASE WHEN len(list_distinct({xs})) > 20 THEN [substring(k, 7) FOR k IN ({keyed})[1:20]] "
            f"ELSE list_sort(list_distinct({xs})) END")


SHORT = f"list_sort(list_distinct(list_concat({_CATEGORY}, {_words('description', rules.SEARCH_STOPWORDS, 2)})))"
CAPPED = _capped(f"list_concat({_CATEGORY}, {_words('description', rules.SEARCH_STOPWORDS, 2)})")
FULL = f"list_sort(list_distinct(list_concat({_CATEGORY}, {_words('description', rules.SEARCH_STOPWORDS_LONG, 3)})))"
WIDE = f"list_sort(list_distinct(list_concat({_words('description', rules.SEARCH_STOPWORDS_LONG, 3)}, {_words('category', rules.SEARCH_STOPWORDS_LONG, 3)})))"
STRICT = _capped(f"list_concat({_words('description', rules.SEARCH_STOPWORDS_LONG, 3)}, {_words('category', rules.SEARCH_STOPWORDS_LONG, 3)})")


@query(f"""WITH {ITEMS_SQL} SELECT item_id, array_to_string({CAPPED}, ' ') AS capped, array_to_string({FULL}, ' ') AS full_,
 array_to_string({STRICT}, ' ') AS strict_ FROM items""")
def search_keywords(spark, sf_dir):
    """The three kinds of keywords, two of them with their cap."""
    def joined(variant, cap=None):
        return F.array_join(text.search_keywords(F.col("description"), F.col("category"), variant, cap), " ")
    return items(spark, sf_dir).select("item_id", joined("short", rules.KEYWORD_CAP).alias("capped"), joined("full").alias("full_"),
                                       joined("strict", rules.KEYWORD_CAP).alias("strict_"))




def _model(x: str) -> str:
    # full case mapping turns a sharp s into two letters, the SQL function does not
    return f"[w FOR w IN regexp_extract_all(upper(replace({x}, 'ß', 'ss')), '{WORD}') IF regexp_matches(w, '^[A-Z0-9]{{3,}}$')]"


def _pieces(x: str) -> str:
    return f"list_distinct([w FOR w IN regexp_split_to_array({x}, '{SPACE}+') IF w <> ''])"


SIGNAL_PARTS = rf"""kws AS (SELECT item_id, description, lower(description) AS low, {FULL} AS kw FROM items),
 pairs AS (SELECT item_id, doc_id, file_name, description, low, lower(text) AS doc, kw FROM kws, library
 WHERE len([k FOR k IN kw IF contains(lower(text), k)]) >= ceil(0.5 * len(kw) - 1e-9)), sig AS (SELECT item_id, doc_id,
 len([k FOR k IN kw IF contains(doc, k)])::DOUBLE / len(kw) AS coverage,
 100.0::DOUBLE * len(list_intersect(list_distinct({_model('low')}), {_model('doc')})) / nullif(len({_model('low')}), 0) AS structural,
 100.0::DOUBLE * len(list_intersect({_pieces('low')}, {_pieces('doc')})) / nullif(len({_pieces('low')}), 0) AS words,
 len([p FOR p IN string_split(low, ',') IF length({trimmed('p')}) > 5 AND contains(doc, {trimmed('p')})]) > 0 AS phrase FROM pairs)"""


@query(f"""WITH {ITEMS_SQL}, {LIBRARY_SQL}, {SIGNAL_PARTS} SELECT item_id, doc_id, round(coverage, 6) AS coverage,
 round(coalesce(structural, 0), 6) AS structural, round(coalesce(words, 0), 6) AS words, phrase FROM sig""")
def text_signals(spark, sf_dir):
    """Every native part of the scores, for items and the documents that hold half of their keywords."""
    docs = library(spark, sf_dir).select("doc_id", F.lower("text").alias("doc"))
    pairs = linking.coverage_links(items(spark, sf_dir), library(spark, sf_dir), 0.5, "full").select("item_id", "doc_id")
    wanted = items(spark, sf_dir).select("item_id", F.lower("description").alias("low"), text.search_keywords(
        F.col("description"), F.col("category"), "full").alias("kw"))
    # the items of a document, a block at a time, meet its text in one row: its tokens are found, and terms are searched, once for all of them
    n, blocks = task_count(spark), max(1, -(-wanted.count() // linking.BLOCK))
    held = pairs.join(wanted, "item_id").repartition(n, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")) \
        .agg(F.collect_list(F.struct("item_id", "low", "kw")).alias("held"))
    low, doc, found = F.col("low"), F.col("doc"), F.col("found")

    def asked(parts):
        """What the descriptions of a document's items hold together."""
        return F.flatten(F.transform("held.low", lambda x: F.coalesce(parts(x), text.literal_array([]))))
    read = held.join(docs.repartition(n, "doc_id"), "doc_id").select(
        "doc_id", "doc", "held", text.found_terms(F.array_distinct(F.concat(F.flatten("held.kw"), asked(text.phrases))), doc).alias("found"),
        F.array_intersect(text.model_tokens(doc), asked(text.model_tokens)).alias("models"),
        F.array_intersect(text.split_words(doc), asked(text.split_words)).alias("said"))
    return read.select("doc_id", "doc", "found", "models", "said", F.inline("held")).select(
        "item_id", "doc_id", F.round(text.coverage(F.col("kw"), doc, found), 6).alias("coverage"),
        F.round(text.structural_overlap(low, doc, F.col("models")), 6).alias("structural"),
        F.round(text.word_overlap(low, doc, theirs=F.col("said")), 6).alias("words"), text.exact_phrase(low, doc, found).alias("phrase"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS long_,
 CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short_ FROM documents""")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("long_"),
                                                    text.preview(F.col("text"), 50).alias("short_"))


@query("""SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(f"""WITH k AS (SELECT conv_id, turn, text, sum(CASE WHEN text <> '' THEN length(text) + 1 ELSE 0 END) OVER (PARTITION BY conv_id
 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations WHERE turn < 5)
 SELECT conv_id, {trimmed("string_agg(text, ' ' ORDER BY turn)")} AS text FROM k
 WHERE text <> '' AND coalesce(before, 0) <= 500 GROUP BY conv_id""")
def text_budget(spark, sf_dir):
    return ranking.text_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", max_parts=5, max_chars=500)


# --- names ----------------------------------------------------------------------------------------

_NORMAL = stem("lower(file_name)")
for _p in (r"[_\-\s]*\([0-9]+\)", r"[_\-\s]*v[0-9]+", r"[_\-\s]*20[0-9]{2}", r"[_\-\s]*(?:updated|final|revised|new|latest)$"):
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p}', '', 'g')"
_NORMAL = rf"regexp_replace(regexp_replace({_NORMAL}, '[_\-\s]+', '_', 'g'), '^[_\-. ]+|[_\-. ]+$', '', 'g')"


def _chain(pick) -> str:
    hits = " ".join(f"WHEN regexp_matches(lower(file_name), '{'|'.join(ps)}') THEN {pick(c, n)}"
                    for c, n, ps in rules.PRIORITY_RULES)
    return f"CASE {hits} ELSE {pick(*rules.DEFAULT_PRIORITY)} END"


_CATEGORY_OF = _chain(lambda c, n: f"'{c}'")
_PRIORITY_OF = _chain(lambda c, n: str(n))


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, {_NORMAL} AS file_key FROM library")
def normalize_file_names(spark, sf_dir):
    return library(spark, sf_dir).select("doc_id", names.normalize_file_name(F.col("file_name")).alias("file_key"))


@query(f"""WITH {LIBRARY_SQL} SELECT doc_id, {_CATEGORY_OF} AS category, {_PRIORITY_OF} AS priority,
 (CASE WHEN {any_of('lower(file_name)', rules.POSITIVE_NAME_PARTS)} THEN 50.0 WHEN {any_of('lower(file_name)', rules.NEGATIVE_NAME_PARTS)}
 THEN -50.0 ELSE 0.0 END)::DOUBLE AS sign FROM library""")
def doc_priorities(spark, sf_dir):
    name = F.col("file_name")
    return library(spark, sf_dir).select("doc_id", names.doc_category(name).alias("category"),
                                         names.doc_priority(name).alias("priority"), names.name_sign(name).alias("sign"))


PRIORITIZED = f"""c AS (SELECT doc_id, supplier, file_name, {_CATEGORY_OF} AS category, {_PRIORITY_OF} AS priority FROM library),
 n AS (SELECT *, row_number() OVER (PARTITION BY supplier, category ORDER BY file_name, doc_id) AS place FROM c),
 kept AS (SELECT * FROM n WHERE place <= CASE category WHEN 'high_priority' THEN 5 WHEN 'medium_priority' THEN 3 WHEN 'unknown' THEN 2 ELSE 0 END)"""


def prioritized(spark, sf_dir):
    return ranking.prioritize(library(spark, sf_dir).select("doc_id", "supplier", "file_name"))


@query(f"WITH {LIBRARY_SQL}, {PRIORITIZED} SELECT doc_id, supplier, category, priority, CAST(place AS INTEGER) AS place FROM kept")
def prioritize_documents(spark, sf_dir):
    return prioritized(spark, sf_dir).select("doc_id", "supplier", "category", "priority", "place")


@query(f"""WITH {LIBRARY_SQL}, {PRIORITIZED}, a AS (SELECT supplier, count(*) AS after,
 count(*) FILTER (WHERE category = 'high_priority') AS high_priority, count(*) FILTER (WHERE category = 'medium_priority') AS medium_priority,
 count(*) FILTER (WHERE category = 'unknown') AS unknown FROM kept GROUP BY supplier), b AS (SELECT supplier, count(*) AS before FROM library GROUP BY 1)
 SELECT supplier, before, coalesce(after, 0) AS after, coalesce(high_priority, 0) AS high_priority, coalesce(medium_priority, 0) AS medium_priority,
 coalesce(unknown, 0) AS unknown, round((before - coalesce(after, 0))::DOUBLE / before * 100, 6) AS removed_pct FROM b LEFT JOIN a USING (supplier)""")
def filter_stats(spark, sf_dir):
    return reports.filter_stats(library(spark, sf_dir), prioritized(spark, sf_dir)) \
        .withColumn("removed_pct", F.round("removed_pct", 6))


@query(f"""WITH {LIBRARY_SQL}, v AS (SELECT DISTINCT source AS supplier FROM documents UNION SELECT n_name FROM nation),
 t AS (SELECT supplier, count(*) AS n, sum(size_bytes) AS bytes, max(modified) AS last FROM library GROUP BY 1)
 SELECT supplier, coalesce(n, 0) AS documents, CAST(coalesce(bytes, 0) AS BIGINT) AS total_bytes,
 round_even(coalesce(bytes, 0)::DOUBLE / 1048576, 2) AS total_mb, strftime(last, '%Y-%m-%d %H:%M') AS last_modified FROM v LEFT JOIN t USING (supplier)""")
def vendor_overview(spark, sf_dir):
    vendors = table(spark, sf_dir, "documents").select(F.col("source").alias("supplier")).unionByName(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("supplier")))
    return reports.vendor_overview(vendors, library(spark, sf_dir)).withColumn(
        "last_modified", F.date_format("last_modified", "yyyy-MM-dd HH:mm"))


@query("""SELECT n_name AS supplier FROM nation WHERE n_name NOT IN (SELECT source FROM documents)""")
def empty_vendors(spark, sf_dir):
    vendors = table(spark, sf_dir, "documents").select(F.col("source").alias("supplier")).unionByName(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("supplier")))
    return reports.vendor_overview(vendors, library(spark, sf_dir), "empty").select("supplier")


@query(f"""WITH {LIBRARY_SQL} SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM library
 WHERE floor((epoch(TIMESTAMP '2025-06-01 12:00:00') - epoch(modified)) / 86400) >= 490""")
def cleanup_preview(spark, sf_dir):
    return reports.cleanup_preview(library(spark, sf_dir), F.lit("2025-06-01 12:00:00").cast("timestamp"), 490)


@query(f"""WITH {LIBRARY_SQL} SELECT doc_id, file_name FROM library WHERE file_name NOT IN (SELECT file_name FROM library JOIN labels USING (doc_id))""")
def orphan_documents(spark, sf_dir):
    docs = library(spark, sf_dir)
    used = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return reports.orphan_docs(docs, used).select("doc_id", "file_name")
