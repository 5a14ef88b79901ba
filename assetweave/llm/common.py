"""What several of the corpus operators share.

Rows are identified by content: two 64-bit hashes of (doc_id, text). Rows that agree in both columns get the same
decision, and null ids are ordinary values.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetweave.session import cut_lineage

KEY = ["_key_a", "_key_b"]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.xxhash64(F.lit(17), F.col(doc_id), F.col(text)).alias(KEY[0]),
            F.xxhash64(F.lit(71), F.col(text), F.col(doc_id)).alias(KEY[1])]


def with_key(df: DataFrame) -> DataFrame:
    """All columns of `df` and the content key."""
    return df.select("*", *row_key())


def connected(nodes: DataFrame, edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (u, v), both long.

    Labels fall to the smallest label among the neighbours and then jump to the label of the label, so chains shrink
    by half and stars end at once. Every round is written to the shared folder; a hub's edges meet in a join that
    AQE can split, and minima are taken map-side first. Only nodes with an edge take part in the rounds.
    """
    both = cut_lineage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                       .filter("u <> v").distinct(), label)
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("low"))
                         .select(F.col("u").alias("node"), F.least("u", "low").alias("component")), label)
    while True:
        near = (both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("low")))
        lower = labels.join(near, labels.node == near.u).select(
            "node", F.least("component", "low").alias("mid"), F.col("component").alias("was"))
        lower = cut_lineage(lower, label)
        jump = lower.select(F.col("node").alias("at"), F.col("mid").alias("further"))
        moved = cut_lineage(lower.join(jump, lower.mid == jump["at"], "left").select(
            "node", F.least("mid", "further").alias("component"), "was"), label)
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            break
    found = labels.withColumnRenamed("node", "_node")
    return nodes.join(found, nodes.node == found["_node"], "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first `keys` columns (integers), from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_REACHED: dict[str, bool] = {}


def reach_workers(spark: SparkSession) -> None:
    """Python workers that can't import this package get its functions by value.

    Workers find it where it is installed, shipped with --py-files or on PYTHONPATH; that is the better way, as they then
    keep their caches from task to task. A local session started elsewhere has neither.
    """
    app = spark.sparkContext.applicationId
    if app in _REACHED:
        return

    def probe(batches):
        import importlib.util

        import pyarrow
        found = importlib.util.find_spec("assetweave") is not None
        for batch in batches:
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([found] * batch.num_rows)], ["found"])
    probe.__module__ = "__main__"
    _REACHED[app] = spark.range(1, numPartitions=1).mapInArrow(probe, "found boolean").first()[0]
    if not _REACHED[app]:
        import assetweave
        cloudpickle.register_pickle_by_value(assetweave)
