"""The operators as Structured Streaming jobs.

Sources are watched folders: the checkpoint of a query is its list of processed files, so
each path is taken once, also over restarts. Micro-batches run one after the other.
"""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetweave import rules
from assetweave.functions import text
from assetweave.operators import classify, learning

POLL = "5 seconds"


def watch_folder(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None,
                 **options) -> DataFrame:
    """New files of a folder as a stream; `files_per_batch=1` takes one file at a time.

    Files must appear complete and under a new name: rewriting a path is not seen.
    """
    if files_per_batch is not None:
        options["maxFilesPerTrigger"] = files_per_batch
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def label_stream(items: DataFrame, description: str, vendor: str | None = None) -> DataFrame:
    """Labels for arriving items; stateless, the batch operator as it is."""
    return classify.classify(items, description, vendor)


def learned_counts(labelled: DataFrame, description: str, label: str, dictionary: DataFrame) -> DataFrame:
    """Running candidate table; the state holds a row per (category, keyword)."""
    return learning.learn_candidates(labelled, description, label, dictionary)


def last_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest time per key; the state holds a row per key."""
    return events.groupBy(key).agg(F.max(ts).alias("last_seen"))


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def to_folder(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the rows of a stateless or deduplicated stream to a Parquet folder."""
    return _start(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, once)


def to_changes(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Running aggregate as a table of changes: each batch adds the rows of the keys that it changed.

    A batch that is run again after a failure replaces its own folder only.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream.writeStream.outputMode("update").foreachBatch(save), checkpoint, once)


def read_changes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row of each key of a table of changes."""
    return _newest(spark.read.parquet(path), *keys)


def _newest(changes: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fold_changes(spark: SparkSession, path: str, target: str, *keys: str) -> None:
    """A table of changes with one row per key, as the first batch of a new folder. Run it while no stream writes."""
    read_changes(spark, path, *keys).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The rows that earlier batches wrote; a batch that runs again doesn't see what its first attempt left."""
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


def _begin(rows: DataFrame, path: str) -> None:
    """An empty first batch, so that the table has a schema from the start."""
    rows.limit(0).write.mode("ignore").parquet(f"{path}/batch=-1")


FILES = "path string, mtime timestamp"


def to_changed_files(stream: DataFrame, path: str, mtime: str, log: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """File events once per (path, modification time), in whatever order and however late they arrive.

    There is no state and no watermark, which would drop late events: every batch is compared with the log of what was
    seen so far, of which only the days of its own modification times are read. A batch that runs again after a failure
    replaces its own folder. `read_changed_files` reads the log.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(F.col(path).cast("string").alias("path"), F.col(mtime).cast("timestamp").alias("mtime")).distinct()
        fresh = fresh.withColumn("day", F.to_date("mtime")).persist()
        days = [r[0] for r in fresh.select("day").distinct().collect()]  # calendar days: few, however many files
        touched = F.col("day").isin([d for d in days if d is not None])
        seen = _before(spark, log, batch_id).filter(touched | F.col("day").isNull() if None in days else touched)
        seen = seen.select(*[F.col(c).alias(f"_{c}") for c in ("day", "path", "mtime")])
        same = F.lit(True)
        for c in ("day", "path", "mtime"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        fresh.join(seen, same, "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={batch_id}")
        fresh.unpersist()

    spark = stream.sparkSession
    first = spark.createDataFrame([], FILES).withColumn("day", F.to_date("mtime"))
    first.union(spark.sql("SELECT CAST(NULL AS string), CAST(NULL AS timestamp), date'1970-01-01'")).write.mode("ignore") \
        .partitionBy("day").parquet(f"{log}/batch=-1")
    return _start(stream.writeStream.foreachBatch(save), checkpoint, once)


def read_changed_files(spark: SparkSession, log: str) -> DataFrame:
    """(path, mtime) of all batches."""
    return spark.read.schema(f"{FILES}, batch long, day date").parquet(log).filter("batch >= 0").select("path", "mtime")


LEARNED = "category string, keyword string, sightings long, weight double, promoted_in long"


def learning_loop(items: DataFrame, description: str, vendor: str | None, dictionary: DataFrame, path: str, checkpoint: str,
                  min_occurrences: float = rules.MIN_OCCURRENCES, once: bool = False) -> StreamingQuery:
    """Label arriving items, learn from them, and promote keywords, batch by batch.

    Every batch is labelled and written to `path`/labelled. What it teaches is counted against the dictionary as it is by then,
    which is `dictionary` and all that earlier batches promoted, and added to the candidates; those that have become heavy
    enough and are valid are promoted, and the next batch already knows them. A promoted keyword keeps the weight that it had then.
    `path`/learned is a table of changes: each batch adds the rows of the keywords that it touched, a batch that runs
    again replaces them and changes nothing else. `learned_keywords` reads the newest.
    """
    def learn(batch: DataFrame, batch_id: int) -> None:
        spark, mine = batch.sparkSession, f"{path}/labelled/batch={batch_id}"
        classify.classify(batch, description, vendor).write.mode("overwrite").parquet(mine)
        labelled = spark.read.schema(classified.schema).parquet(mine)
        known = _newest(_before(spark, f"{path}/learned", batch_id), "category", "keyword")
        promoted = known.filter("promoted_in IS NOT NULL").select("category", "keyword")
        taught = learning.learn_candidates(labelled, description, "label", dictionary.select("category", "keyword").unionByName(promoted))
        had = known.select("category", "keyword", F.col("sightings").alias("_sightings"), F.col("weight").alias("_weight"))
        # weights are sums of a few decimals; rounding keeps them exact over any number of batches
        total = taught.join(had, ["category", "keyword"], "left").select(
            "category", "keyword", (F.col("sightings") + F.coalesce("_sightings", F.lit(0))).alias("sightings"),
            F.round(F.col("weight") + F.coalesce("_weight", F.lit(0.0)), 6).alias("weight"))
        ready = (F.col("weight") >= min_occurrences) & text.keyword_verdict(F.col("keyword"))["valid"]
        total.withColumn("promoted_in", F.when(ready, F.lit(batch_id).cast("long"))) \
            .write.mode("overwrite").parquet(f"{path}/learned/batch={batch_id}")

    classified = classify.classify(items, description, vendor)
    _begin(items.sparkSession.createDataFrame([], LEARNED), f"{path}/learned")
    return _start(items.writeStream.foreachBatch(learn), checkpoint, once)


def learned_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(category, keyword, sightings, weight, promoted_in) after the last batch; promoted_in is null for candidates."""
    return _newest(spark.read.parquet(f"{path}/learned"), "category", "keyword")


def with_run_log(stream: DataFrame, handle, log_path: str, checkpoint: str, file: Column | str = "file",
                 once: bool = False) -> StreamingQuery:
    """Run `handle(batch, batch_id)` per micro-batch and append its run to the log table.

    The handler must compute the batch it is given once, as by one write; rows and file are observed on the way.
    The log has a row per batch: run, time, file, rows, seconds, status. A failing handler is
    logged and stops the query.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, begun, status, seen = batch.sparkSession, datetime.now(timezone.utc), "success", Observation()
        try:
            handle(batch.observe(seen, F.max(file).alias("file"), F.count(F.lit(1)).alias("rows")), batch_id)
        except Exception:
            status = "failed"
            raise
        finally:
            seconds = (datetime.now(timezone.utc) - begun).total_seconds()
            told = seen.get if status == "success" else {"file": None, "rows": None}
            spark.createDataFrame(
                [(batch_id, begun.isoformat(timespec="seconds"), told["file"], told["rows"], seconds, status)],
                "run long, time string, file string, rows long, seconds double, status string",
            ).write.mode("append").parquet(log_path)

    return _start(stream.writeStream.foreachBatch(run), checkpoint, once)
