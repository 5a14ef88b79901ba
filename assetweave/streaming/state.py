"""Keys that have been quiet for a while, from the state of session windows.

The state lives in the RocksDB store, so that it may outgrow memory; `rocksdb` sets it for the queries started within.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave import rules

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def due_again(events: DataFrame, key: str, ts: str, days: int = rules.RESCAN_DAYS, lateness: str = "1 day") -> DataFrame:
    """(key, last_seen, due) of a stream: a key becomes due `days` after its last event, and again only after a new one.

    Times are those of the events. A row appears when the watermark, which stays `lateness` behind the newest event,
    has passed the due time; earlier events are then known, so the rows are those that a batch over all events gives. Events
    that come later than `lateness` are left out, and so are rows without key or time. Events of a key that follow each other within
    the period are one session, whose end is the due time; the state holds a row per open session, and the events of the last
    `lateness`, among which each counts once. All of it runs in the JVM: a keyed state in Python costs calls per key and batch.
    Start it within `rocksdb`.
    """
    timed = (events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("_at"))
             .withWatermark("_at", lateness).dropDuplicates([key, "_at"]))
    # a session window would take a late event whose session is still open; the removal of repeated ones drops it before
    # hours, as a day of the session's time zone may have 23 or 25
    gap = F.session_window("_at", f"{days * 24} hours")
    found = timed.groupBy(F.col(key), gap.alias("_open")).agg(F.max("_at").alias("last_seen"))
    return found.select(key, "last_seen", (F.col("last_seen") + F.expr(f"INTERVAL {days * 24} HOURS")).alias("due"))
