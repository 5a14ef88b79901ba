"""Progress, run history and item lists."""

from pyspark.sql import functions as F

from assetweave.operators import ranking, reports
from assetweave.plans.catalog.registry import query, role, table
from assetweave.sources import readers

ITEMS = "SELECT doc_id AS item_id, source FROM documents "
RESULTS = "SELECT doc_id AS item_id, quality FROM labels UNION ALL SELECT doc_id, toxic FROM labels "


@query(f"""WITH i AS ({ITEMS}), r AS ({RESULTS}), n AS (SELECT count(*) AS total FROM i), p AS (SELECT count(DISTINCT item_id) AS processed FROM r)
 SELECT total, processed, total - processed AS remaining, round(100.0 * processed / total, 6) AS progress FROM n, p""")
def progress(spark, sf_dir):
    return reports.progress(role(spark, sf_dir, ITEMS, "documents"), role(spark, sf_dir, RESULTS, "labels")) \
        .withColumn("progress", F.round("progress", 6))


@query(f"WITH i AS ({ITEMS}), r AS ({RESULTS}) SELECT item_id, source FROM i WHERE item_id NOT IN (SELECT item_id FROM r)")
def remaining_items(spark, sf_dir):
    return reports.remaining_items(role(spark, sf_dir, ITEMS, "documents"), role(spark, sf_dir, RESULTS, "labels"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 700")
def resume_from(spark, sf_dir):
    return reports.resume_from(table(spark, sf_dir, "orders"), "o_orderkey", 700).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderstatus) = 'f' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def list_items(spark, sf_dir):
    return ranking.list_items(table(spark, sf_dir, "orders"), "F", 20, "o_orderstatus", "o_orderdate", "o_orderkey") \
        .select("o_orderkey", "o_orderstatus")


LOGS = """SELECT 'run_' || lpad(CAST(user_id AS VARCHAR(20)), 9, '0') AS run, '2024-05-' || lpad(CAST(1 + user_id % 28 AS VARCHAR(9)), 2, '0') ||
  ' 10:00:00 start' || chr(10) || CASE WHEN user_id % 4 = 0 THEN '' ELSE 'Input file:   orders of user ' || CAST(user_id AS VARCHAR(20)) ||
  ' and a long tail of words.xlsx' END || chr(10) || CASE WHEN user_id % 5 = 0 THEN 'stopped' ELSE 'Finished in ' || CAST(sum(event_id % 1000) AS VARCHAR(20)) || '.5 s' END || chr(10) ||
  CASE WHEN user_id % 3 = 0 THEN 'stage FAILED' ELSE 'ok' END || chr(10) || 'PIPELINE COMPLETE' AS content FROM events GROUP BY user_id """


def runs(spark, sf_dir):
    return role(spark, sf_dir, LOGS, "events").select("run", *readers.run_facts(F.col("content")))


FACTS = r"""l AS (""" + LOGS + r"""), facts AS (SELECT run, coalesce(nullif(regexp_extract(content, '(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1), ''), '-') AS time,
 coalesce(trim(nullif(regexp_extract(content, '(?m)Input file:\s*(.+?)$', 1), '')), '-') AS file,
 try_cast(nullif(regexp_extract(content, '(?i)finished in ([\d.]+) s', 1), '') AS DOUBLE) AS seconds,
 CASE WHEN contains(content, 'PIPELINE COMPLETE') AND NOT contains(content, 'FAILED') THEN 'success' ELSE 'failed' END AS status FROM l)"""


@query(f"WITH {FACTS} SELECT run, time, file, seconds, status FROM facts")
def run_log_facts(spark, sf_dir):
    return runs(spark, sf_dir)


@query(f"""WITH {FACTS} SELECT run, time, left(file, 30) AS file, CASE WHEN seconds IS NULL THEN '-' ELSE CAST(CAST(floor(seconds / 60) AS BIGINT) AS VARCHAR) || 'm' END AS duration, status
 FROM facts ORDER BY run DESC LIMIT 5""")
def run_history(spark, sf_dir):
    return reports.run_history(runs(spark, sf_dir), 5, 30)


@query(r"""WITH f AS (SELECT 'sheet' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '_labeled' ELSE '' END || '.xlsx' AS file_name, o_orderdate AS modified FROM orders)
 SELECT file_name FROM f ORDER BY suffix(file_name, '_labeled.xlsx') DESC, modified DESC, file_name DESC LIMIT 1""")
def latest_input(spark, sf_dir):
    files = role(spark, sf_dir, """SELECT 'sheet' || CAST(o_orderkey AS VARCHAR(20)) || CASE WHEN o_orderkey % 5 = 0 THEN '_labeled' ELSE '' END || '.xlsx'
        AS file_name, o_orderdate AS modified FROM orders """, "orders")
    return readers.latest_input(files, "file_name", "modified")
