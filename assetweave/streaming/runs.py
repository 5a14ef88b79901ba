"""Runs of streaming queries as rows, also of those that die outside of any handler."""

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "run string, name string, event string, at string, batch long, rows long, seconds double, error string"


class RunRecorder(StreamingQueryListener):
    """Writes a row when a query starts, after every batch, and when it ends.

    with RunRecorder(spark, path) as runs:
        query = start_some_stream()
        runs.wait(query)

    Rows are appended as they come, so a driver that is killed leaves an open run behind. Rows of one run stay in order by batch;
    an error that the log itself meets is kept in `errors` and never stops a query.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self._spark, self._path, self._only = spark, path, name
        self._ended: dict[str, threading.Event] = {}
        self._names: dict[str, str | None] = {}
        self._lock = threading.Lock()
        self.errors: list[Exception] = []

    def __enter__(self) -> "RunRecorder":
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        if self._only is None or event.name == self._only:
            self._names[str(event.runId)] = event.name
            self._write(event.runId, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if str(told.runId) in self._names:
            self._write(told.runId, "batch", told.timestamp, told.batchId, told.numInputRows, told.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self._names:
            self._write(run, "failed" if event.exception else "success", error=event.exception)
        self._end_of(run).set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the end of a query, and of its row, is known. An error of the query is in the log and isn't raised here."""
        try:
            query.awaitTermination()
        except Exception as error:
            if query.isActive:
                raise error
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of run {query.runId} after {seconds} s")

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def _write(self, run, event: str, at: str | None = None, batch=None, rows=None, seconds=None, error=None) -> None:
        at = at or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        try:
            row = (str(run), self._names[str(run)], event, at, batch, rows, seconds, error)
            self._spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(self._path)
        except Exception as problem:
            self.errors.append(problem)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, name, started, ended, batches, rows, seconds, status, error), a row per run.

    Status is success or failed; `open` is a run without an end: it is still going, or its driver was killed.
    """
    events = spark.read.schema(EVENTS).parquet(path)
    batch, end = F.col("event") == "batch", F.col("event").isin("success", "failed")
    return events.groupBy("run").agg(
        F.max("name").alias("name"), F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started"),
        F.max(F.when(end, F.col("at"))).alias("ended"), F.count_distinct(F.when(batch, F.col("batch"))).alias("batches"),
        F.coalesce(F.sum(F.when(batch, F.col("rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(batch, F.col("seconds"))), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.max(F.when(end, F.col("event"))), F.lit("open")).alias("status"),
        F.max("error").alias("error"))
