"""Classification, keyword learning and label curation."""

from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import text
from assetweave.functions.arrays import explode_computed
from assetweave.operators import classify, learning
from assetweave.plans.catalog.registry import WORD, SPACE, any_of, in_list, query, role, table, trimmed

VENDORS = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Carl Zeiss ' || c_name WHEN 1 THEN 'UPS Freight'
  WHEN 2 THEN 'ADOBE ' || c_mktsegment WHEN 3 THEN 'Groups of ' || c_name WHEN 4 THEN 'Oracle at Olympus'
  WHEN 5 THEN NULL ELSE c_name END AS vendor FROM customer """


def _vendor_case(x: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, terms)} THEN '{label}'" for label, terms in rules.VENDOR_RULES) \
        + f" ELSE {otherwise} END"


def _signal_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, terms)} THEN '{label}'" for label, terms in rules.SIGNAL_RULES) \
        + " ELSE 'Unknown' END"


@query(f"WITH v AS ({VENDORS}) SELECT c_custkey, {_vendor_case('lower(vendor)', 'NULL')} AS label FROM v")
def classify_vendors(spark, sf_dir):
    return classify.classify_vendor(role(spark, sf_dir, VENDORS, "customer"), "vendor").select("c_custkey", "label")


PURCHASED = """SELECT doc_id, text AS description, CASE doc_id % 10 WHEN 0 THEN 'Carl Zeiss' WHEN 1 THEN 'UPS'
  WHEN 2 THEN 'MathWorks ' || source WHEN 3 THEN NULL ELSE source END AS vendor FROM documents """


def purchased(spark, sf_dir):
    return role(spark, sf_dir, PURCHASED, "documents")


LABELLED = f"""p AS ({PURCHASED}), l AS (SELECT doc_id, description, vendor, CASE WHEN description IS NULL OR description = ''
 THEN 'Unknown' ELSE {_vendor_case('lower(vendor)', _signal_case('lower(description)'))} END AS label FROM p)"""


def labelled(spark, sf_dir):
    return classify.classify(purchased(spark, sf_dir), "description", "vendor")


@query(f"WITH {LABELLED} SELECT doc_id, label FROM l")
def classify_items(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "label")


@query(f"""SELECT label, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM (
 SELECT l_quantity, {_vendor_case('lower(s_name)', _signal_case('lower(p_name)'))} AS label
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY label""")
def classify_purchases(spark, sf_dir):
    lines, parts, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    # a description and vendor are classified once, not once per purchase
    bought = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    named = bought.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return classify.classify(named, "p_name", "s_name").groupBy("label").agg(
        F.sum("n").alias("n"), F.sum("q").cast("long").alias("quantity"))


@query(f"""SELECT doc_id, CASE {' '.join(rf"WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(t)})($|[^\p{{L}}\p{{N}}_])') THEN '{label}'"
        for label, t in rules.SIGNAL_RULES)} ELSE 'Unknown' END AS label FROM documents""")
def classify_whole_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify.classify(docs, "text", whole_word=True).select("doc_id", "label")


DICTIONARY = f"""SELECT DISTINCT category, keyword FROM (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'hw' ELSE 'ni' END AS category, lower(p_type) AS keyword FROM part
  UNION ALL SELECT 'hw', lower(p_name) FROM part
  UNION ALL SELECT 'sw', lower(text) FROM benchmark
  UNION ALL SELECT 'ni', lower(source) FROM documents)"""


def dictionary(spark, sf_dir):
    return role(spark, sf_dir, DICTIONARY, "part", "benchmark", "documents")


LEGACY = """SELECT DISTINCT category, keyword FROM (
  SELECT 'hw' AS category, lower(p_type) AS keyword FROM part
  UNION ALL SELECT 'hw', split_part(lower(p_name), ' ', 1) FROM part
  UNION ALL SELECT 'sw', split_part(lower(p_name), ' ', 2) FROM part
  UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN 'hw' ELSE 'sw' END, CASE WHEN item_id % 2 = 0 THEN
    lower(split_part(text, ' ', 2)) ELSE lower(text) END FROM benchmark WHERE text <> '')"""


@query(f"""WITH d AS ({LEGACY}) SELECT doc_id, CASE
 WHEN EXISTS (SELECT 1 FROM d WHERE category = 'hw' AND contains(lower(text), keyword)) THEN 'Instrument'
 WHEN EXISTS (SELECT 1 FROM d WHERE category = 'sw' AND contains(lower(text), keyword)) THEN 'Software'
 ELSE 'Non-Instrument' END AS label FROM documents""")
def classify_by_dictionary(spark, sf_dir):
    terms = role(spark, sf_dir, LEGACY, "part", "benchmark")
    return classify.classify_by_dictionary(table(spark, sf_dir, "documents"), "doc_id", "text", terms) \
        .select("doc_id", "label")


@query(f"""WITH {LABELLED} SELECT coalesce(CASE WHEN label <> 'Unknown' THEN label END, 'Unlabeled') AS label,
 count(*) AS n FROM l GROUP BY 1""")
def label_counts(spark, sf_dir):
    known = labelled(spark, sf_dir).withColumn("label", F.nullif("label", F.lit("Unknown")))
    return classify.label_counts(known, "label")


@query(f"""WITH {LABELLED}, t AS (SELECT label, CASE WHEN quality = 1 THEN 'Non-Instrument' WHEN quality = 0 THEN
 'Unknown' END AS truth FROM l LEFT JOIN labels USING (doc_id)) SELECT count(*) AS total,
 count(*) FILTER (WHERE label IS DISTINCT FROM truth) AS differences,
 round(100.0 * count(*) FILTER (WHERE label IS NOT DISTINCT FROM truth) / count(*), 6) AS agreement FROM t""")
def compare_labels(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Non-Instrument")
                                                  .when(F.col("quality") == 0, "Unknown").alias("truth"))
    both = labelled(spark, sf_dir).join(truth, "doc_id", "left")
    return classify.compare_labels(both, "label", "truth").withColumn("agreement", F.round("agreement", 6))


# --- learning ------------------------------------------------------------------------------
# RE2 has ASCII word boundaries only, so the SQL wraps non-ASCII letters in Q, an upper-case
# letter that lower-cased text cannot hold, matches, and takes the Q away again.

_WRAPPED = r"regexp_replace(lower(description), '([^\x00-\x7f])', 'Q\1Q', 'g')"
_EDGE = r"[.,;:()\[\]{}\"''\-]"
TOKENS = rf"""(SELECT [w FOR w IN [regexp_replace(x, '^{_EDGE}+|{_EDGE}+$', '', 'g') FOR x IN regexp_split_to_array(
 replace(regexp_replace(regexp_replace({_WRAPPED}, '\b[0-9\-]{{6,}}\b', '', 'g'),
 '\b(?:\d+|\d+\.\d+)\s*(cu\.ft\.|volts?|v|w|a|hz|rpm|db|lux|psi|bar)\b', '', 'g'), 'Q', ''), '{SPACE}+')]
 IF length(w) >= 3 AND w NOT IN {in_list(rules.STOPWORDS + rules.UNITS)} AND NOT regexp_matches(w, '^\p{{Nd}}+[a-z]*$')])"""


@query(f"WITH p AS ({PURCHASED}) SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM p")
def learning_tokens(spark, sf_dir):
    tokens = text.learning_tokens(F.col("description"))
    return purchased(spark, sf_dir).select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def _weight_sql(technical: str) -> str:
    return f"""least(CAST(3 AS DOUBLE), (CASE WHEN {technical} THEN 1.5 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN keyword IN {in_list(rules.COMMON_NOUNS)} THEN 0.5 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN length(keyword) > 8 AND {any_of('keyword', rules.COMPOUND_PARTS)} THEN 1.3 ELSE 1.0 END)::DOUBLE
 * (CASE WHEN length(keyword) < 4 THEN 0.7 WHEN length(keyword) > 20 THEN 0.8 ELSE 1.0 END)::DOUBLE)"""


_TECHNICAL = any_of("lower(description)", rules.TECHNICAL_CONTEXT)
SIGHTINGS = f"""{LABELLED}, d AS ({DICTIONARY}), s AS (
 SELECT CASE label WHEN 'Research Instrument' THEN 'hw' WHEN 'Software' THEN 'sw' ELSE 'ni' END AS category,
 {_TECHNICAL} AS technical, unnest({TOKENS}) AS keyword FROM l WHERE label <> 'Unknown')"""
CANDIDATES = f"""{SIGHTINGS}, c AS (SELECT category, keyword, count(*) AS sightings, sum({_weight_sql('technical')}) AS weight
 FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.category = s.category AND d.keyword = s.keyword) GROUP BY category, keyword)"""


def candidates(spark, sf_dir):
    return learning.learn_candidates(labelled(spark, sf_dir), "description", "label", dictionary(spark, sf_dir))


@query(f"WITH {CANDIDATES} SELECT category, keyword, sightings, round(weight, 6) AS weight FROM c")
def learn_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"""WITH p AS ({PURCHASED}), t AS (SELECT DISTINCT unnest({TOKENS}) AS keyword, {_TECHNICAL} AS technical FROM p)
 SELECT keyword, technical, round({_weight_sql('technical')}, 6) AS weight FROM t""")
def keyword_weights(spark, sf_dir):
    seen = purchased(spark, sf_dir).select(
        text.technical_context(F.lower("description")).alias("technical"),
        text.learning_tokens(F.col("description")).alias("tokens"))
    seen = explode_computed(seen, F.col("tokens"), "keyword", "technical").distinct()
    return seen.withColumn("weight", F.round(text.keyword_weight(F.col("keyword"), F.col("technical")), 6))


_REASON = rf"""CASE WHEN length(keyword) < 3 THEN 'Too short' WHEN keyword IN {in_list(rules.UNITS)} THEN 'Measurement unit'
 WHEN regexp_matches(keyword, '^[a-z0-9\-]{{2,}}$') AND length(keyword) > 6 THEN 'Model number pattern'
 WHEN regexp_matches(keyword, '^\p{{Nd}}+[a-z]*$') THEN 'Number pattern'
 WHEN keyword IN {in_list(rules.STOPWORDS)} THEN 'Common stopword'
 WHEN {any_of('keyword', rules.TECHNICAL_PARTS)} THEN 'Technical term'
 WHEN length(keyword) BETWEEN 4 AND 15 THEN 'Valid keyword' ELSE 'Failed validation' END"""


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS keyword FROM documents)
 SELECT keyword, {_REASON} AS reason, {_REASON} IN ('Technical term', 'Valid keyword') AS valid FROM v""")
def validate_keywords(spark, sf_dir):
    seen = explode_computed(table(spark, sf_dir, "documents"), text.words(F.lower("text")), "keyword").distinct()
    return seen.withColumn("v", text.keyword_verdict(F.col("keyword"))).select("keyword", "v.reason", "v.valid")


_PROMOTED = f"""{CANDIDATES}, r AS (SELECT category, keyword, round(weight, 6) AS weight, {_REASON} AS reason FROM c
 WHERE round(weight, 6) >= 5), q AS (SELECT *, reason IN ('Technical term', 'Valid keyword') AS promoted FROM r)"""


def _rounded(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_PROMOTED} SELECT category, keyword, weight, promoted, reason FROM q")
def promote_keywords(spark, sf_dir):
    return learning.promote(_rounded(spark, sf_dir), dictionary(spark, sf_dir))


@query(f"""WITH {_PROMOTED} SELECT category, keyword FROM d UNION ALL SELECT category, keyword FROM q WHERE promoted""")
def updated_dictionary(spark, sf_dir):
    terms = dictionary(spark, sf_dir)
    return learning.updated_dictionary(terms, learning.promote(_rounded(spark, sf_dir), terms))


@query(f"""WITH {CANDIDATES} SELECT category, count(*) AS candidates, round(sum(weight), 4) AS total_weight,
 round(avg(weight), 4) AS avg_weight, count(*) FILTER (WHERE round(weight, 6) >= 5) AS ready FROM c GROUP BY category""")
def learning_analytics(spark, sf_dir):
    out = learning.learning_analytics(_rounded(spark, sf_dir))
    return out.withColumn("total_weight", F.round("total_weight", 4)).withColumn("avg_weight", F.round("avg_weight", 4))


@query(f"""WITH {CANDIDATES}, w AS (SELECT category, keyword, round(weight, 6) AS weight FROM c), k AS (SELECT category,
 CAST(row_number() OVER (PARTITION BY category ORDER BY weight DESC, keyword) AS INTEGER) AS rank, keyword, weight FROM w)
 SELECT * FROM k WHERE rank <= 10""")
def top_candidates(spark, sf_dir):
    return learning.top_candidates(_rounded(spark, sf_dir), 10)


@query(f"WITH {CANDIDATES} SELECT category, keyword, round(weight, 6) AS weight FROM c WHERE round(weight, 6) >= 5")
def ready_candidates(spark, sf_dir):
    return learning.ready_candidates(_rounded(spark, sf_dir))


# --- curation -------------------------------------------------------------------------------

STOCK = """SELECT doc_id, ' ' || CASE WHEN doc_id % 5 = 0 THEN 'Dup-' || source ELSE 'Doc-' ||
  CAST(doc_id AS VARCHAR(20)) END AS code, source AS supplier,
  CASE WHEN lang = 'en' THEN 'Instrument' WHEN lang = 'fr' THEN NULL ELSE 'Software' END AS item_type FROM documents """
CORRECTIONS = """SELECT 'DOC-' || CAST(doc_id AS VARCHAR(20)) AS code, CASE WHEN toxic = 1 THEN 'Non-Instrument' ELSE
  'Instrument' END AS new_label FROM labels UNION ALL SELECT 'dup-' || source, 'Software' FROM documents """


@query(f"""WITH s AS ({STOCK}), k AS (SELECT *, lower({trimmed('code')}) AS key FROM s),
 w AS (SELECT lower(code) AS key, max(new_label) AS new_label FROM ({CORRECTIONS}) GROUP BY 1),
 n AS (SELECT key, count(*) AS n FROM k GROUP BY key)
 SELECT doc_id, coalesce(CASE WHEN n.n = 1 AND {trimmed('item_type')} IS DISTINCT FROM w.new_label THEN w.new_label END, item_type) AS item_type,
 w.new_label IS NOT NULL AND n.n = 1 AND {trimmed('item_type')} IS DISTINCT FROM w.new_label AS changed
 FROM k JOIN n USING (key) LEFT JOIN w USING (key)""")
def relabel(spark, sf_dir):
    fixes = role(spark, sf_dir, CORRECTIONS, "labels", "documents")
    return classify.relabel(role(spark, sf_dir, STOCK, "documents"), fixes, "code", "item_type") \
        .select("doc_id", "item_type", "changed")


@query(f"""WITH s AS ({STOCK}) SELECT doc_id, CASE WHEN regexp_matches(lower(supplier), 'c1[0-4]') THEN 'Software'
 ELSE item_type END AS item_type, regexp_matches(lower(supplier), 'c1[0-4]') AS changed FROM s""")
def relabel_by_supplier(spark, sf_dir):
    return classify.relabel_by_supplier(role(spark, sf_dir, STOCK, "documents"), "supplier", "C1[0-4]", "item_type",
                                        "Software").select("doc_id", "item_type", "changed")


CHOSEN = "SELECT CASE WHEN quality = 0 THEN 'Doc-' ELSE 'Other-' END || CAST(doc_id AS VARCHAR(20)) AS code FROM labels"


@query(f"""WITH s AS ({STOCK}) SELECT doc_id, item_type FROM s WHERE {trimmed('code')} IN ({CHOSEN})""")
def export_subset(spark, sf_dir):
    return classify.export_subset(role(spark, sf_dir, STOCK, "documents"), role(spark, sf_dir, CHOSEN, "labels"), "code") \
        .select("doc_id", "item_type")
