"""Sources and sinks: each query writes what Spark derives from the tables and reads it back."""

from pyspark.sql import functions as F

from assetweave.functions.arrays import explode_computed
from assetweave.operators import reports
from assetweave.plans.catalog.labels import CANDIDATES, LABELLED, dictionary, labelled, learn_candidates
from assetweave.plans.catalog.links import MATCHES, SUMMARY, plain_items, previewed_matches
from assetweave.plans.catalog.registry import query, table, trimmed
from assetweave.plans.catalog.suppliers import MASTER, master
from assetweave.session import cut_lineage, shared_folder
from assetweave.sources import readers, writers

SHEET_ROWS = 1000


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS description, p_brand AS supplier FROM part")
def read_items(spark, sf_dir):
    """Part sheets of a thousand rows at most, with a title line above the header and the columns in two orders."""
    odd = F.floor(F.col("p_partkey") / SHEET_ROWS) % 2 == 1
    line = F.when(odd, F.concat_ws(",", "p_brand", F.col("p_partkey").cast("string"), "p_name")).otherwise(
        F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand"))
    lines = table(spark, sf_dir, "part").select(
        F.concat(F.floor(F.col("p_partkey") / SHEET_ROWS), F.lit("-"), F.col("p_partkey") % 2).alias("sheet"), odd.alias("odd"),
        F.struct("p_partkey", line.alias("line")).alias("l"))
    sheets = lines.groupBy("sheet", "odd").agg(F.array_sort(F.collect_list("l")).alias("ls")).select("sheet", F.concat(
        F.lit("Exported parts,,\n"), F.when(F.col("odd"), "supplier,code,description\n").otherwise("code,description,supplier\n"),
        F.array_join(F.col("ls.line"), "\n")).alias("value"))
    path = shared_folder(spark, "sheets")
    sheets.write.partitionBy("sheet").text(path)
    return readers.read_items(spark, f"{path}/*", "csv").select("code", "description", "supplier")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
 SELECT doc_id, lower({trimmed('value')}) AS keyword FROM l WHERE {trimmed('value')} <> '' AND NOT starts_with({trimmed('value')}, '#')""")
def parse_dictionary(spark, sf_dir):
    lines = explode_computed(table(spark, sf_dir, "documents"), F.split("text", "\n"), "value", "doc_id")
    return readers.parse_dictionary(lines).select("doc_id", "keyword")


@query("SELECT source AS supplier, count(*) AS n, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY source")
def scan_library(spark, sf_dir):
    """A folder per supplier and a file per document; number and size of the files come from the scan alone, which
    never reads contents."""
    docs, path = table(spark, sf_dir, "documents").filter("text is not null"), shared_folder(spark, "library")
    writers.write_files(docs.withColumn("text", F.regexp_replace("text", r"[\r\n]", " ")), "doc_id", "source", "text", path)
    files = readers.scan_library(spark, path, "*.txt").withColumn("supplier", F.regexp_replace("supplier", "^folder=", ""))
    return files.groupBy("supplier").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {LABELLED} SELECT label AS TYPE, doc_id, source || '_labeled' AS source FROM l JOIN documents USING (doc_id)")
def write_labeled(spark, sf_dir):
    rows = labelled(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id") \
        .select("doc_id", "label", "source")
    path = shared_folder(spark, "labeled")
    writers.write_labeled(rows, "label", "source", path)
    return spark.read.parquet(path).select("TYPE", "doc_id", "source")


@query(f"""WITH {MASTER}, n AS (SELECT 'NEW#' || upper(c_mktsegment) AS supplier, arg_min('https://' || c_name, c_custkey) AS website FROM customer GROUP BY 1)
 SELECT supplier, website FROM master UNION ALL SELECT supplier, website FROM n""")
def append_absent(spark, sf_dir):
    path = shared_folder(spark, "master")
    known = master(spark, sf_dir)
    known.write.parquet(path)
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NEW#"), F.upper("c_mktsegment")).alias("supplier"), F.concat(F.lit("https://"), "c_name").alias("website"), "c_custkey")
    writers.append_absent(rows.unionByName(known.withColumn("c_custkey", F.lit(-1).cast("long"))), path, "supplier", "c_custkey")
    return spark.read.parquet(path)


@query(f"WITH {CANDIDATES} SELECT category, keyword, round(weight, 6) AS weight, 5::BIGINT AS min_occurrences FROM c")
def learning_log(spark, sf_dir):
    path = shared_folder(spark, "learning")
    writers.save_learning(learn_candidates(spark, sf_dir), path, {"min_occurrences": 5, "confidence_threshold": 0.7}, "2024-01-01T00:00:00")
    return writers.load_learning(spark, path).withColumn("min_occurrences", F.lit(writers.load_settings(spark, path)["min_occurrences"]))


@query("SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id")
def state_table(spark, sf_dir):
    """Two versions; readers see the newest finished one."""
    events, path = table(spark, sf_dir, "events"), shared_folder(spark, "state")
    writers.write_version(events.groupBy("user_id").agg(F.min("event_id").alias("last_event")), path, 1)
    writers.write_version(events.groupBy("user_id").agg(F.max("event_id").alias("last_event")), path, 2)
    return writers.read_latest(spark, path)


@query("""SELECT category, keyword, 20240101 AS snapshot_ts FROM (SELECT DISTINCT category, keyword FROM (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'hw' ELSE 'ni' END AS category, lower(p_type) AS keyword FROM part
  UNION ALL SELECT 'hw', lower(p_name) FROM part UNION ALL SELECT 'sw', lower(text) FROM benchmark
  UNION ALL SELECT 'ni', lower(source) FROM documents))""")
def snapshot(spark, sf_dir):
    path = shared_folder(spark, "snapshots")
    writers.snapshot(dictionary(spark, sf_dir), path, "20240101")
    return spark.read.parquet(path)


@query(f"""WITH {MATCHES}, {SUMMARY} SELECT items, matches, round(match_rate, 6) AS match_rate, (SELECT count(*) FROM items LEFT JOIN matches
 USING (item_id)) AS detail_rows, (SELECT count(DISTINCT supplier) FROM matches) AS vendors FROM summary""")
def match_report(spark, sf_dir):
    """Detail and vendor tables and a JSON summary, read back and counted."""
    found, wanted = cut_lineage(previewed_matches(spark, sf_dir), "matches"), plain_items(spark, sf_dir)
    path = shared_folder(spark, "report")
    writers.write_match_report(reports.match_detail(wanted, found), reports.match_summary(wanted, found),
                               reports.vendor_match_stats(found), path)
    detail = spark.read.parquet(f"{path}/detail").agg(F.count("*").alias("detail_rows"), F.lit(1).alias("_one"))
    vendors = spark.read.parquet(f"{path}/vendors").agg(F.count("*").alias("vendors"), F.lit(1).alias("_one"))
    summary = spark.read.schema("items long, matches long, match_rate double").json(f"{path}/summary")
    return summary.withColumn("match_rate", F.round("match_rate", 6)).withColumn("_one", F.lit(1)) \
        .join(detail, "_one").join(vendors, "_one").drop("_one")
