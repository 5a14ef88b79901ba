"""Name cleaning, column roles and row filters."""

from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import names
from assetweave.operators import cleaning, columns, filters
from assetweave.plans.catalog.registry import (
    ITEMS_SQL, LIBRARY_SQL, any_of, items, library, query, role, stem, table, trimmed)

DIRTY = """SELECT c_custkey AS row_id, c_mktsegment AS source, CASE c_custkey % 8
  WHEN 0 THEN c_name || '***USE V#' || CAST(c_custkey AS VARCHAR(20)) || '***'
  WHEN 1 THEN '  ' || c_name || ' (use code ' || CAST(c_custkey AS VARCHAR(20)) || ')'
  WHEN 2 THEN '***' || c_name WHEN 3 THEN c_name || '   GmbH ***'
  WHEN 4 THEN '***' || c_name || '***use v#1***(USE ' || CAST(c_nationkey AS VARCHAR(9)) || ')'
  WHEN 5 THEN '***' WHEN 6 THEN NULL ELSE c_name END AS name FROM customer """


def dirty(spark, sf_dir):
    return role(spark, sf_dir, DIRTY, "customer")


def _cleaned(x: str) -> str:
    out = trimmed(x)
    for pattern, flags in ((r"\*\*\*USE V#\d+\*\*\*", "gi"), (r"\(USE[^)]*\)", "gi"),
                           (r"^\*+", "g"), (r"\*+$", "g")):
        out = f"regexp_replace({out}, '{pattern}', '', '{flags}')"
    return trimmed(rf"regexp_replace({out}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g')")


_WITH = f"WITH d AS ({DIRTY}), c AS (SELECT *, {_cleaned('name')} AS cleaned, {trimmed('name')} AS bare FROM d)"


@query(f"{_WITH} SELECT row_id, cleaned FROM c")
def clean_names(spark, sf_dir):
    return cleaning.clean(dirty(spark, sf_dir), "name").select("row_id", F.col("name").alias("cleaned"))


@query(rf"""{_WITH}, t AS (SELECT row_id, bare AS original, concat_ws(',',
   CASE WHEN regexp_matches(bare, '(?i)\*\*\*USE V#\d+\*\*\*') THEN 'use_code_suffix' END,
   CASE WHEN regexp_matches(bare, '(?i)\(USE[^)]*\)') THEN 'use_code_parens' END,
   CASE WHEN starts_with(bare, '*') THEN 'leading_asterisks' END,
   CASE WHEN suffix(bare, '*') THEN 'trailing_asterisks' END) AS issues FROM c WHERE bare IS NOT NULL)
 SELECT * FROM t WHERE issues <> ''""")
def detect_issues(spark, sf_dir):
    return cleaning.detect_issues(dirty(spark, sf_dir), "name").select(
        "row_id", "original", F.array_join("issues", ",").alias("issues"))


@query(f"{_WITH} SELECT row_id, name AS before, cleaned AS after FROM c WHERE bare <> cleaned")
def clean_diff(spark, sf_dir):
    return cleaning.clean_diff(dirty(spark, sf_dir), "name", "row_id")


@query(f"""{_WITH} SELECT source, count(*) AS rows_total,
 count(*) FILTER (WHERE bare <> cleaned) AS rows_cleaned FROM c GROUP BY ROLLUP (source)""")
def clean_stats(spark, sf_dir):
    return cleaning.clean_stats(dirty(spark, sf_dir), "name", "source")


# files of a cleaning run: those with rows, one of which reported an error, and some from which nothing was read
LISTED = """SELECT source, CASE WHEN source = 'BUILDING' THEN 'damaged sheet' END AS error FROM (SELECT c_mktsegment AS source FROM customer
 UNION SELECT n_name FROM nation) """


@query(f"""{_WITH}, f AS ({LISTED}), s AS (SELECT source, count(*) AS rows_total, count(*) FILTER (WHERE bare <> cleaned) AS rows_cleaned FROM c GROUP BY source)
 SELECT source, coalesce(rows_total, 0) AS rows_total, coalesce(rows_cleaned, 0) AS rows_cleaned, CASE WHEN error IS NOT NULL OR rows_total IS NULL
 THEN 'failed' WHEN rows_cleaned > 0 THEN 'cleaned' ELSE 'unchanged' END AS status, error FROM f LEFT JOIN s USING (source)""")
def clean_status(spark, sf_dir):
    """What became of every file of a cleaning run."""
    stats = cleaning.clean_stats(dirty(spark, sf_dir), "name", "source")
    return cleaning.clean_status(role(spark, sf_dir, LISTED, "customer", "nation"), stats, "source")


COMPANY = """SELECT c_custkey AS row_id, CASE c_custkey % 6 WHEN 0 THEN 'The ' || c_name || ' Inc'
  WHEN 1 THEN c_name || ' Corporation' WHEN 2 THEN c_name || ' Company' WHEN 3 THEN c_name || ' Co'
  WHEN 4 THEN 'Usable Medical ' || c_mktsegment || ' Limited' ELSE c_name || ' Technologies GmbH' END AS name
  FROM customer """


def _anywhere(x: str) -> str:
    for suffix in rules.URL_NAME_SUFFIXES:
        x = f"replace({x}, '{suffix}', '')"
    return x


@query(rf"""WITH d AS ({COMPANY}) SELECT row_id, {_anywhere('lower(name)')} AS anywhere,
 {trimmed(r"regexp_replace(" + trimmed("regexp_replace(lower(name), '( inc| corp| ltd| llc| co| company| limited)$', '')") + ", '^the ', '')")}
 AS anchored FROM d""")
def strip_suffixes(spark, sf_dir):
    name = F.col("name")
    return role(spark, sf_dir, COMPANY, "customer").select(
        "row_id", names.strip_suffixes(name, "anywhere").alias("anywhere"),
        names.strip_suffixes(name, "anchored").alias("anchored"))


SHEET = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS TYPE,
  CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE ' P-' || CAST(p_partkey AS VARCHAR(20)) END AS `Item Code`,
  CASE WHEN p_partkey % 3 = 0 THEN 'nan' ELSE p_name END AS `Item Description`,
  p_brand || ' ' || p_name AS `Description`,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS `Supplier Name`, p_type AS Category FROM part """


def _filled(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(nullif({trimmed(c)}, ''), 'nan')" for c in cols)


@query("WITH s AS (" + SHEET.replace("`", '"') + f""") SELECT {_filled('"Item Code"')}, 'ITEM_' || CAST(p_partkey AS VARCHAR)) AS item_code,
 {_filled('"Item Description"', '"Description"')}, '') AS description, {_filled('"Supplier Name"')}) AS supplier,
 {_filled('Category')}, '') AS category, {_filled('TYPE')}, '') AS item_type FROM s""")
def coalesce_roles(spark, sf_dir):
    return columns.coalesce_roles(role(spark, sf_dir, SHEET, "part"), "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'nan' ELSE p_name END AS description,
 CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS supplier FROM part""")
def resolve_roles(spark, sf_dir):
    """Columns found by name: the substring rule and the ordered candidates agree on this sheet."""
    sheet = role(spark, sf_dir, SHEET, "part")
    found = columns.resolve_by_candidates(sheet)
    return sheet.select("p_partkey", F.col(f"`{columns.resolve_by_substring(sheet, 'description')}`").alias("description"),
                        F.col(f"`{found['supplier']}`").alias("supplier"))


@query("SELECT l_discount, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def drop_by_position(spark, sf_dir):
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    kept = columns.drop_by_position(table(spark, sf_dir, "lineitem").select(*order), keep=("l_returnflag",))
    return kept.groupBy(*kept.columns).agg(F.count("*").alias("n"))


LABELLED_PARTS = """SELECT p_partkey, p_name, p_brand, CASE p_partkey % 6 WHEN 0 THEN ' Non-Instrument'
  WHEN 1 THEN 'SOFTWARE ' WHEN 2 THEN 'Instrument' WHEN 3 THEN 'Research Instrument' WHEN 4 THEN '' ELSE NULL END
  AS item_type FROM part """
_TYPE = f"lower({trimmed('item_type')})"


def labelled_parts(spark, sf_dir):
    return role(spark, sf_dir, LABELLED_PARTS, "part")


@query(f"""WITH p AS ({LABELLED_PARTS}) SELECT p_partkey, item_type FROM p
 WHERE coalesce({_TYPE}, '') NOT IN ('non-instrument', 'software')""")
def exclude_types(spark, sf_dir):
    return filters.exclude_types(labelled_parts(spark, sf_dir), "item_type").select("p_partkey", "item_type")


@query(f"""WITH p AS ({LABELLED_PARTS}) SELECT p_partkey, item_type FROM p
 WHERE {_TYPE} IN ('instrument', 'research instrument')""")
def include_types(spark, sf_dir):
    return filters.include_types(labelled_parts(spark, sf_dir), "item_type").select("p_partkey", "item_type")


@query(f"""WITH p AS ({LABELLED_PARTS}) SELECT p_partkey, p_name FROM p
 WHERE (regexp_matches(lower(p_name), 'ring|b.lt') OR regexp_matches(lower(p_brand), 'ring|b.lt'))
   AND (item_type IS NULL OR {trimmed('item_type')} = '')""")
def search_unlabeled(spark, sf_dir):
    return filters.search(labelled_parts(spark, sf_dir), "Ring|B.lt", ["p_name", "p_brand"],
                          "item_type", "unlabeled").select("p_partkey", "p_name")


@query(f"""WITH p AS ({LABELLED_PARTS}) SELECT p_partkey, p_name FROM p
 WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear')""")
def search_plain(spark, sf_dir):
    return filters.search(labelled_parts(spark, sf_dir), "gear", ["p_name", "p_brand"], regex=False) \
        .select("p_partkey", "p_name")


@query(f"""WITH {LIBRARY_SQL} SELECT doc_id, supplier, file_name FROM library WHERE size_bytes > 0
 AND size_bytes <= 52428800 AND NOT {any_of('lower(file_name)', rules.SKIPPED_NAME_PARTS)}
 AND length({trimmed('text')}) >= 800""")
def doc_gate(spark, sf_dir):
    return filters.doc_gate(library(spark, sf_dir)).select("doc_id", "supplier", "file_name")


DOWNLOADS = """SELECT source AS supplier, 'https://' || source || '.example.com/files/' ||
  CAST(doc_id % 97 AS VARCHAR(9)) || (CASE WHEN doc_id % 2 = 0 THEN '.pdf?x=1' ELSE '' END) AS url,
  n_chars * n_chars AS size_bytes, CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE 'text/html' END
  AS content_type, doc_id FROM documents """
HAVE = """SELECT source AS supplier, CAST(doc_id % 97 AS VARCHAR(9)) || CASE WHEN lang = 'de' THEN '.pdf' ELSE '.part' END AS file_name FROM documents """


@query(f"""WITH d AS ({DOWNLOADS}), h AS ({HAVE}), f AS (SELECT *, CAST(doc_id % 97 AS VARCHAR) || '.pdf' AS file_name
 FROM d WHERE size_bytes BETWEEN 512 AND 104857600 AND (contains(content_type, 'pdf') OR suffix(lower(url), '.pdf')))
 SELECT doc_id, supplier, file_name FROM f
 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.supplier = f.supplier AND h.file_name = f.file_name)""")
def download_gate(spark, sf_dir):
    return filters.download_gate(role(spark, sf_dir, DOWNLOADS, "documents"), role(spark, sf_dir, HAVE, "documents"),
                                 check_type=True).select("doc_id", "supplier", "file_name")


STATE = """SELECT CASE WHEN c_nationkey < 20 THEN '' ELSE 'closed ' END || CAST(c_custkey AS VARCHAR(20)) AS supplier, CASE WHEN c_custkey % 9 = 0 THEN 'not a time'
  ELSE '2024-03-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR(9)), 2, '0') || ' 06:30:00' END AS last_seen
  FROM customer """
SITES = "SELECT CAST(c_custkey AS VARCHAR(20)) AS supplier, c_name FROM customer "


@query(f"""WITH sites AS ({SITES}), state AS ({STATE}) SELECT supplier, c_name FROM sites LEFT JOIN state USING (supplier)
 WHERE last_seen IS NULL OR try_cast(last_seen AS TIMESTAMP) IS NULL
 OR floor((epoch(TIMESTAMP '2024-03-20 00:00:00') - epoch(try_cast(last_seen AS TIMESTAMP))) / 86400) >= 7""")
def due_for_rescan(spark, sf_dir):
    return filters.due_for_rescan(role(spark, sf_dir, SITES, "customer"), role(spark, sf_dir, STATE, "customer"),
                                  F.lit("2024-03-20 00:00:00").cast("timestamp"))


@query(f"""WITH {LIBRARY_SQL} SELECT doc_id, CAST(floor((epoch(TIMESTAMP '2025-06-01 12:00:00') - epoch(modified)) / 86400)
 AS BIGINT) AS age_days FROM library WHERE floor((epoch(TIMESTAMP '2025-06-01 12:00:00') - epoch(modified)) / 86400) >= 490""")
def older_than(spark, sf_dir):
    return filters.older_than(library(spark, sf_dir), "modified", F.lit("2025-06-01 12:00:00").cast("timestamp"), 490) \
        .select("doc_id", "age_days")


@query(f"WITH {ITEMS_SQL} SELECT item_id, item_code FROM items ORDER BY item_id LIMIT 20")
def sample_head(spark, sf_dir):
    return filters.sample_head(items(spark, sf_dir), 20, "item_id").select("item_id", "item_code")


FILES = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '~$' ELSE '' END || 'sheet' ||
  CAST(o_orderkey AS VARCHAR(20)) || CASE o_orderkey % 5 WHEN 0 THEN '_labeled' ELSE '' END ||
  CASE o_orderkey % 3 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.xls' ELSE '.csv' END AS file_name, o_orderdate AS modified
  FROM orders """


@query(rf"""WITH f AS ({FILES}) SELECT o_orderkey, file_name FROM f WHERE regexp_matches(lower(file_name), '\.xlsx?$')
 AND NOT starts_with(file_name, '~$') AND NOT suffix({stem('file_name')}, '_labeled')""")
def input_names(spark, sf_dir):
    return role(spark, sf_dir, FILES, "orders").filter(names.is_input_name(F.col("file_name"))) \
        .select("o_orderkey", "file_name")
