"""Streaming jobs over the supplied tables as arriving files, run to the end of the input.

Each table is dealt into several files in no order of time, which arrive one per micro-batch. The checking SQL is
the batch answer over the whole table.
"""

from pyspark.sql import functions as F

from assetweave.plans.catalog.labels import _REASON, CANDIDATES, LABELLED, PURCHASED, SIGHTINGS, _weight_sql, dictionary
from assetweave.plans.catalog.registry import bind, query, table
from assetweave.session import shared_folder
from assetweave.streaming import jobs, runs, state

ARRIVALS = 4


def _stream(spark, sf_dir, name):
    arriving, path = table(spark, sf_dir, name), shared_folder(spark, "arriving")
    arriving.repartition(ARRIVALS, F.xxhash64(*arriving.columns)).write.parquet(path)
    return jobs.watch_folder(spark, path, arriving.schema, files_per_batch=1)


def _deliveries(arriving, part, parts=ARRIVALS):
    """A stream per part 0, 1, ... of a table, to be run to its end before the next is asked for. Each finds the files of its part as
    new, however many tasks wrote them, and takes them as one batch."""
    spark, path = arriving.sparkSession, shared_folder(arriving.sparkSession, "arriving")
    numbered = arriving.withColumn("_arrives", part)
    for k in range(parts):
        numbered.filter(F.col("_arrives") == k).drop("_arrives").write.mode("append").parquet(path)
        yield jobs.watch_folder(spark, path, arriving.schema)


def _purchased(spark, sf_dir):
    return bind(spark, PURCHASED, documents=_stream(spark, sf_dir, "documents"))


def _finish(query_):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query(f"WITH {LABELLED} SELECT doc_id, label FROM l")
def label_stream(spark, sf_dir):
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "marks")
    labelled = jobs.label_stream(_purchased(spark, sf_dir), "description", "vendor").select("doc_id", "label")
    _finish(jobs.to_folder(labelled, out, mark, once=True))
    return spark.read.schema("doc_id long, label string").parquet(out)


@query(f"WITH {CANDIDATES} SELECT category, keyword, sightings, round(weight, 6) AS weight FROM c")
def learn_stream(spark, sf_dir):
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "marks")
    labelled = jobs.label_stream(_purchased(spark, sf_dir), "description", "vendor")
    _finish(jobs.to_changes(jobs.learned_counts(labelled, "description", "label", dictionary(spark, sf_dir)), out, mark, once=True))
    return jobs.read_changes(spark, out, "category", "keyword").withColumn("weight", F.round("weight", 6))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM events GROUP BY user_id")
def last_seen_stream(spark, sf_dir):
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "marks")
    _finish(jobs.to_changes(jobs.last_seen(_stream(spark, sf_dir, "events"), "user_id", "ts"), out, mark, once=True))
    return jobs.read_changes(spark, out, "user_id").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""SELECT user_id || '/' || event_type AS path, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS mtime FROM events GROUP BY ALL""")
def modified_files_stream(spark, sf_dir):
    log, mark = shared_folder(spark, "seen"), shared_folder(spark, "marks")
    changes = _stream(spark, sf_dir, "events").select(
        F.concat_ws("/", F.col("user_id"), "event_type").alias("path"), F.date_trunc("hour", "ts").alias("mtime"))
    _finish(jobs.to_changed_files(changes, "path", "mtime", log, mark, once=True))
    return jobs.read_changed_files(spark, log).withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm"))


# keywords that an earlier file has made heavy enough are known when the next one comes
@query(f"""WITH {SIGHTINGS.replace("unnest(", "doc_id % 4 AS part, unnest(", 1)}, c AS (SELECT category, keyword, part, count(*) AS sightings,
 sum({_weight_sql('technical')}) AS weight FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.category = s.category AND d.keyword = s.keyword)
 GROUP BY category, keyword, part),
 u AS (SELECT category, keyword, part, CAST(sum(sightings) OVER w AS BIGINT) AS sightings, round(sum(weight) OVER w, 6) AS weight FROM c
  WINDOW w AS (PARTITION BY category, keyword ORDER BY part)),
 v AS (SELECT *, CASE WHEN weight >= 5 AND {_REASON} IN ('Technical term', 'Valid keyword') THEN part END AS promoted_in FROM u),
 f AS (SELECT category, keyword, min(promoted_in) AS first FROM v GROUP BY category, keyword)
 SELECT category, keyword, sightings, weight, promoted_in FROM v JOIN f USING (category, keyword)
 WHERE first IS NULL OR part <= first QUALIFY row_number() OVER (PARTITION BY category, keyword ORDER BY part DESC) = 1""")
def learn_loop_stream(spark, sf_dir):
    """Documents arrive in four deliveries; promoted keywords count from the next delivery on."""
    out, mark = shared_folder(spark, "learning"), shared_folder(spark, "marks")
    for arriving in _deliveries(table(spark, sf_dir, "documents"), F.col("doc_id") % ARRIVALS):
        _finish(jobs.learning_loop(bind(spark, PURCHASED, documents=arriving), "description", "vendor", dictionary(spark, sf_dir), out, mark, once=True))
    return jobs.learned_keywords(spark, out)


@query("""WITH e AS (SELECT DISTINCT user_id || '/' || event_type AS supplier, ts FROM events),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY supplier ORDER BY ts) AS later FROM e)
 SELECT supplier, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S.%f') AS due FROM n
 WHERE (later IS NULL OR later > ts + INTERVAL 7 DAY) AND ts + INTERVAL 7 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def due_stream(spark, sf_dir):
    """Who is due again seven days after the last event; events arrive up to 16 hours out of order."""
    out, mark = shared_folder(spark, "stream"), shared_folder(spark, "marks")
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id"), "event_type").alias("supplier"), "ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 3) * F.lit(8 * 3600 * 1_000_000)
    low, high = events.agg(F.min(at), F.max(at)).first()
    parts = 2 * ARRIVALS
    with state.rocksdb(spark):
        for arriving in _deliveries(events, F.floor((at - low) * parts / F.lit(high - low + 1)), parts):
            _finish(jobs.to_folder(state.due_again(arriving, "supplier", "ts"), out, mark, once=True))
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return spark.read.schema("supplier string, last_seen timestamp, due timestamp").parquet(out).select(
        "supplier", F.date_format("last_seen", stamp).alias("last_seen"), F.date_format("due", stamp).alias("due"))


@query("SELECT max(o_orderpriority) AS file, count(*) AS logged, count(*) AS n_rows, true AS all_succeeded FROM orders")
def run_log_stream(spark, sf_dir):
    """One micro-batch per file; the handler stores the batch, the log gets a row. Totals over all runs."""
    out, log, mark = (shared_folder(spark, x) for x in ("stream", "runs", "marks"))

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    orders = _stream(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"))
    _finish(jobs.with_run_log(orders, store, log, mark, once=True))
    stored = spark.read.parquet(out).agg(F.count("*").alias("n_rows"), F.lit(1).alias("_one"))
    runs = spark.read.parquet(log).agg(F.max("file").alias("file"), F.sum("rows").alias("logged"),
                                       F.bool_and(F.col("status") == "success").alias("all_succeeded"), F.lit(1).alias("_one"))
    return runs.join(stored, "_one").drop("_one")


@query("""SELECT CAST(4 AS BIGINT) AS batches, count(*) AS n_rows, 'success' AS status FROM orders UNION ALL
 SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'failed' FROM orders HAVING max(o_orderkey) IS NOT NULL""")
def run_events_stream(spark, sf_dir):
    """Runs as a listener sees them: one that stores all orders, and one that dies on its first."""
    out, log = shared_folder(spark, "stream"), shared_folder(spark, "runs")
    orders = _stream(spark, sf_dir, "orders").select("o_orderkey")
    broken = orders.select(F.raise_error(F.concat(F.lit("order "), F.col("o_orderkey"))).cast("string").alias("o_orderkey"))
    with runs.RunRecorder(spark, log) as recorder:
        for name, stream in (("stored", orders), ("broken", broken)):
            recorder.wait(jobs.to_folder(stream, f"{out}/{name}", shared_folder(spark, "marks"), once=True))
    return runs.read_runs(spark, log).select("batches", F.col("rows").alias("n_rows"), "status")
