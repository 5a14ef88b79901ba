"""Master lists, entity matching and URL confidence."""

from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import text, urls
from assetweave.functions.arrays import explode_computed
from assetweave.operators import ranking, reports, resolve
from assetweave.plans.catalog.quality import _anywhere
from assetweave.plans.catalog.registry import SPACE, any_of, in_list, query, role, table, trimmed

MASTER_ROWS = """SELECT c_custkey AS pos, CASE c_custkey % 3 WHEN 0 THEN ' supplier#' ELSE 'Supplier#' END ||
  lpad(CAST(CAST(floor(c_custkey / 20) AS BIGINT) AS VARCHAR(20)), 9, '0') AS name,
  CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'ftp://x' WHEN 3 THEN 'http://localhost:80/'
  ELSE ' https://www.s' || CAST(c_custkey AS VARCHAR(20)) || '.example.com/ ' END AS website FROM customer """
MASTER = f"""rows_ AS ({MASTER_ROWS}), master AS (SELECT upper({trimmed('name')}) AS supplier,
 arg_max({trimmed('website')}, pos) AS website FROM rows_ WHERE name <> '' AND website <> '' GROUP BY 1)"""


def master_rows(spark, sf_dir):
    return role(spark, sf_dir, MASTER_ROWS, "customer")


def master(spark, sf_dir):
    return resolve.load_master(master_rows(spark, sf_dir), "name", "website", "pos")


BOUGHT = """SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(9)) || '-' ||
  CAST(l_partkey AS VARCHAR(20)) AS item_code, p_name AS description, CASE WHEN l_suppkey % 4 = 0 THEN ' ' ||
  lower(s_name) ELSE s_name END AS supplier FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey """


def bought(spark, sf_dir):
    return role(spark, sf_dir, BOUGHT, "lineitem", "part", "supplier")


_BOUGHT_KEYED = f"b AS ({BOUGHT}), items AS (SELECT item_code, description, upper({trimmed('supplier')}) AS supplier FROM b)"


def keyed(spark, sf_dir):
    return bought(spark, sf_dir).withColumn("supplier", F.upper(text.strip(F.col("supplier"))))


@query(f"WITH {MASTER} SELECT supplier, website FROM master")
def load_master(spark, sf_dir):
    return master(spark, sf_dir)


@query(f"""WITH r AS ({MASTER_ROWS}) SELECT {trimmed('name')} AS supplier, {trimmed('website')} AS website FROM r
 WHERE {trimmed('name')} <> '' AND regexp_matches({trimmed('website')}, '^(?i:https?)://[^/?#]')
 AND NOT contains(website, 'localhost') AND NOT contains(website, '127.0.0.1')""")
def load_supplier_pairs(spark, sf_dir):
    return resolve.load_supplier_pairs(master_rows(spark, sf_dir), "name", "website")


@query(f"WITH {_BOUGHT_KEYED} SELECT DISTINCT supplier FROM items")
def distinct_suppliers(spark, sf_dir):
    return resolve.distinct_suppliers(bought(spark, sf_dir), "supplier")


@query(f"""WITH {MASTER}, {_BOUGHT_KEYED} SELECT DISTINCT supplier, coalesce(website, '') AS website,
 CASE WHEN website IS NULL THEN 'unknown' ELSE 'master_list' END AS source FROM items LEFT JOIN master USING (supplier)""")
def split_known(spark, sf_dir):
    known, unknown = resolve.split_known(resolve.distinct_suppliers(bought(spark, sf_dir), "supplier"), master(spark, sf_dir))
    return known.unionByName(unknown.select("supplier", F.lit("").alias("website"), F.lit("unknown").alias("source")))


@query(f"""WITH {MASTER}, {_BOUGHT_KEYED} SELECT item_code, supplier, website FROM items LEFT JOIN master USING (supplier)""")
def attach_master(spark, sf_dir):
    return resolve.attach_master(keyed(spark, sf_dir), master(spark, sf_dir)).select("item_code", "supplier", "website")


@query(f"""WITH {MASTER}, b AS ({BOUGHT}) SELECT website, count(*) AS n FROM b LEFT JOIN master
 ON lower({trimmed('b.supplier')}) = lower(master.supplier) GROUP BY website""")
def attach_master_folded(spark, sf_dir):
    return resolve.attach_master(bought(spark, sf_dir), master(spark, sf_dir), fold=True) \
        .groupBy("website").agg(F.count("*").alias("n"))


@query(f"""WITH r AS ({MASTER_ROWS}), m AS (SELECT upper({trimmed('name')}) AS supplier, max(coalesce(CASE WHEN pos % 20 < 10
 THEN '' ELSE website END, '')) AS website FROM r GROUP BY 1), m2 AS (SELECT supplier,
 CASE WHEN supplier LIKE '%5' THEN '' ELSE website END AS website FROM m), {_BOUGHT_KEYED},
 f AS (SELECT supplier, min(item_code) AS item_code FROM items GROUP BY supplier),
 g AS (SELECT f.supplier, f.item_code, min(description) AS description FROM f JOIN items USING (supplier, item_code) GROUP BY ALL)
 SELECT g.supplier, item_code, description, CASE WHEN m2.supplier IS NULL THEN 'Missing from Master List'
 ELSE 'In Master List but No Website' END AS status FROM g LEFT JOIN m2 USING (supplier)
 WHERE m2.supplier IS NULL OR {trimmed('website')} = ''""")
def missing_suppliers(spark, sf_dir):
    listed = spark.sql(f"""WITH m AS (SELECT upper(trim(name)) AS supplier, max(coalesce(CASE WHEN pos % 20 < 10 THEN ''
        ELSE website END, '')) AS website FROM {{r}} GROUP BY 1)
        SELECT supplier, CASE WHEN supplier LIKE '%5' THEN '' ELSE website END AS website FROM m""",
                       r=master_rows(spark, sf_dir))
    items = keyed(spark, sf_dir).withColumn("place", F.struct("item_code", "description"))
    return resolve.missing_suppliers(items, listed, "place")


@query(f"""WITH {MASTER}, {_BOUGHT_KEYED} SELECT CASE WHEN master.supplier IS NULL THEN 'left_only' ELSE 'both' END AS outcome,
 count(*) AS n_rows, count(DISTINCT items.supplier) AS suppliers FROM items LEFT JOIN master USING (supplier) GROUP BY 1""")
def join_audit(spark, sf_dir):
    return resolve.join_audit(keyed(spark, sf_dir), master(spark, sf_dir))


@query(f"""WITH {MASTER}, r AS (SELECT upper('supplier#' || lpad(CAST(c_custkey % 97 AS VARCHAR), 9, '0')) AS supplier,
 c_name AS contact, c_custkey AS pos FROM customer), f AS (SELECT * FROM r WHERE supplier NOT IN (SELECT supplier FROM master))
 SELECT supplier, arg_min(contact, pos) AS contact, min(pos) AS pos FROM f GROUP BY supplier""")
def append_if_absent(spark, sf_dir):
    rows = role(spark, sf_dir, """SELECT upper('supplier#' || lpad(CAST(c_custkey % 97 AS VARCHAR(9)), 9, '0')) AS supplier,
        c_name AS contact, c_custkey AS pos FROM customer """, "customer")
    return resolve.append_if_absent(master(spark, sf_dir), rows, "supplier", "pos")


ALIASES = "SELECT s_name AS supplier, 'DIR ' || n_name AS folder FROM supplier JOIN nation ON s_nationkey = n_nationkey"
# suppliers without an alias get a name that nobody has
ALIASES = ALIASES.replace('s_name AS supplier', "CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' (old)' ELSE s_name END AS supplier")


@query(f"""WITH b AS ({BOUGHT}), a AS ({ALIASES}) SELECT coalesce(folder, b.supplier) AS folder, count(*) AS n
 FROM b LEFT JOIN a USING (supplier) GROUP BY 1""")
def apply_aliases(spark, sf_dir):
    return resolve.apply_aliases(bought(spark, sf_dir), role(spark, sf_dir, ALIASES, "supplier", "nation")) \
        .groupBy("folder").agg(F.count("*").alias("n"))


# --- entity matching --------------------------------------------------------------------------

NAMES = """SELECT DISTINCT CASE c_custkey % 9 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' Holdings East'
  WHEN 2 THEN CAST(1000000 + c_custkey AS VARCHAR(9)) WHEN 3 THEN 'East ' || c_mktsegment || ' Works ' || CAST(c_nationkey AS VARCHAR(9))
  WHEN 4 THEN 'The ' || replace(c_name, '#', ' No ') || ' Inc' WHEN 5 THEN 'Western ' || c_mktsegment || ' Trading and Shipping'
  WHEN 6 THEN 'Unrelated ' || CAST(c_custkey AS VARCHAR(20)) WHEN 7 THEN 'The Plant ' || CAST(c_custkey AS VARCHAR(20)) || ' Corp'
  ELSE c_name END AS name FROM customer """
TARGETS = """SELECT DISTINCT target FROM (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Plant ' || CAST(c_custkey AS VARCHAR(20)) || ' Ltd' END AS target FROM customer
  UNION ALL SELECT c_mktsegment || ' Trading ' || CAST(c_nationkey AS VARCHAR(9)) FROM customer
  UNION ALL SELECT n_name FROM nation)"""
_CLEAN = "regexp_replace(trim(regexp_replace(lower({0}), '( inc| corp| ltd| llc| co| company| limited)$', '')), '^the ', '')"


@query(rf"""WITH n AS ({NAMES}), t AS ({TARGETS}), w AS (SELECT name, lower(name) AS l, list_distinct([x FOR x IN
 regexp_split_to_array(lower(name), '{SPACE}+') IF x <> '']) AS ws FROM n), v AS (SELECT target, lower(target) AS l,
 list_distinct([x FOR x IN regexp_split_to_array(lower(target), '{SPACE}+') IF x <> '']) AS ws FROM t),
 m AS (SELECT name, target, CASE WHEN w.l = v.l THEN 1 WHEN contains(w.l, v.l) OR contains(v.l, w.l) THEN 2
 WHEN len(list_intersect(w.ws, v.ws)) >= greatest(1, len(w.ws) * 0.5) THEN 3
 WHEN {_CLEAN.format('name')} = {_CLEAN.format('target')} THEN 4 END AS s FROM w, v),
 f AS (SELECT name, min(s) AS s FROM m WHERE s IS NOT NULL GROUP BY name)
 SELECT name, min(target) AS target, CASE s WHEN 1 THEN 'exact' WHEN 2 THEN 'containment' WHEN 3 THEN 'words' ELSE 'cleaned' END
 AS strategy FROM m JOIN f USING (name, s) GROUP BY name, s""")
def resolve_entities(spark, sf_dir):
    return resolve.resolve_entities(role(spark, sf_dir, NAMES, "customer"), role(spark, sf_dir, TARGETS, "customer", "nation"))


@query()
def suggest_similar(spark, sf_dir):
    def vocabulary(name, column, out):
        return explode_computed(table(spark, sf_dir, name), text.words(F.lower(column)), out).distinct()
    return resolve.suggest_similar(vocabulary("benchmark", "text", "name"), vocabulary("conversations", "text", "target"),
                                   cutoff=0.85, k=3)


# --- URL confidence ------------------------------------------------------------------------------

HITS = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Example Works Inc' WHEN 1 THEN 'Acme-Labs Co' ELSE 'Www Medical' END
  || ' ' || CAST(page_id % 99 AS VARCHAR(9)) AS supplier, CASE WHEN floor(page_id / 99) % 2 = 0 THEN 'first' ELSE 'second' END
  AS engine, CAST(1 + floor(page_id / 198) AS INTEGER) AS pos, CASE WHEN page_id % 99 % 4 = 0 THEN 'https://www.agree' ||
  CAST(page_id % 99 AS VARCHAR(9)) || '.com/' WHEN page_id % 7 = 0 THEN 'http://shop.amazon.org/x' WHEN page_id % 11 = 0
  THEN 'not_a_url' ELSE url END AS url FROM pages """
_DOMAIN = r"replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1)), 'www.', '')"
_SCORED = rf"""h AS ({HITS}), d AS (SELECT *, {_DOMAIN} AS domain, CASE engine WHEN 'first' THEN 0 ELSE 1 END AS e FROM h WHERE pos <= 3),
 a AS (SELECT supplier, coalesce(max(CASE WHEN e = 0 AND pos = 1 THEN domain END) = max(CASE WHEN e = 1 AND pos = 1 THEN domain END), false)
 AS agree FROM d GROUP BY supplier), o AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY e, pos) - 1 AS place FROM d),
 u AS (SELECT *, row_number() OVER (PARTITION BY supplier, domain ORDER BY place) AS nth FROM o WHERE domain <> ''),
 s AS (SELECT supplier, place, url, domain, CASE WHEN agree THEN 40 ELSE 10 END
 + CASE WHEN len([w FOR w IN regexp_split_to_array({_anywhere('lower(supplier)')}, '{SPACE}+|-') IF length(w) > 2 AND contains(domain, w)]) > 0 THEN 25 ELSE 0 END
 + CASE WHEN starts_with(url, 'https://') THEN 15 ELSE 0 END
 + CASE WHEN contains(domain, '.') AND regexp_extract(domain, '([^.]*)$', 1) IN {in_list(rules.TRUSTED_TLDS)} THEN 10 ELSE 0 END
 + CASE WHEN {any_of('domain', rules.DIRECTORY_SITES)} THEN 0 ELSE 20 END AS score FROM u JOIN a USING (supplier) WHERE nth = 1)"""
ENGINES = ("first", "second")


def hits(spark, sf_dir):
    return role(spark, sf_dir, HITS, "pages")


def hit_suppliers(spark, sf_dir):
    return hits(spark, sf_dir).select("supplier").distinct()


@query(f"WITH {_SCORED} SELECT supplier, CAST(place AS INTEGER) AS place, url, domain, score FROM s")
def score_urls(spark, sf_dir):
    return resolve.score_hits(hits(spark, sf_dir), ENGINES)


_BEST = f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY score DESC, place) AS k FROM s),
 b AS (SELECT n.supplier, coalesce(url, '') AS url, coalesce(score, 0) AS score FROM (SELECT DISTINCT supplier FROM h) n
 LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (supplier))"""


def best(spark, sf_dir):
    return resolve.pick_best_url(hit_suppliers(spark, sf_dir), hits(spark, sf_dir), ENGINES)


@query(f"WITH {_BEST} SELECT * FROM b")
def pick_best_url(spark, sf_dir):
    return best(spark, sf_dir)


_STATUS = "CASE WHEN score >= 70 AND url <> '' THEN 'Auto-Added' ELSE 'Pending Review' END"


@query(f"WITH {_BEST} SELECT *, {_STATUS} AS status FROM b")
def route_by_confidence(spark, sf_dir):
    return resolve.route_by_confidence(best(spark, sf_dir))


@query(f"""WITH {MASTER}, {_BEST} SELECT supplier, website, 'master_list' AS source FROM master
 UNION ALL SELECT supplier, url, 'auto_resolved' FROM b WHERE {_STATUS} = 'Auto-Added'""")
def union_sources(spark, sf_dir):
    known = master(spark, sf_dir).withColumn("source", F.lit("master_list"))
    return resolve.union_sources(known, resolve.route_by_confidence(best(spark, sf_dir)))


@query(f"""WITH h AS ({HITS}), d AS (SELECT supplier, {_DOMAIN} AS domain, page_id AS pos, url FROM h) SELECT supplier, domain,
 min(pos) AS pos, arg_min(url, pos) AS url FROM d WHERE domain <> '' GROUP BY supplier, domain""")
def first_per_domain(spark, sf_dir):
    return ranking.first_per_domain(hits(spark, sf_dir).withColumn("pos", F.col("page_id")), urls.url_domain(F.col("url")))


FOLDERS = "SELECT DISTINCT upper(source) AS supplier FROM documents "
SHEET = """SELECT doc_id, CASE WHEN source IN ('src1', 'src4', 'src9') THEN ' ' || upper(source) WHEN doc_id % 3 = 0
  THEN 'src2' ELSE NULL END AS `Supplier Name`, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'src5' END AS Vendor FROM documents """


@query("WITH i AS (" + SHEET.replace("`", '"') + f"""), f AS ({FOLDERS}), l AS (
 SELECT doc_id, 0 AS rank, lower({trimmed('"Supplier Name"')}) AS k FROM i UNION ALL SELECT doc_id, 1, lower({trimmed('Vendor')}) FROM i),
 w AS (SELECT k, min(rank) AS rank FROM l GROUP BY k)
 SELECT f.supplier AS folder, doc_id FROM f JOIN w ON w.k = lower(f.supplier) JOIN l ON l.k = w.k AND l.rank = w.rank""")
def items_by_supplier(spark, sf_dir):
    return reports.items_by_supplier(role(spark, sf_dir, SHEET, "documents"), role(spark, sf_dir, FOLDERS, "documents"),
                                     rules.SUPPLIER_LINK_COLUMNS).select("folder", "doc_id")
