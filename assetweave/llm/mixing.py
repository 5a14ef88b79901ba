"""Mixing sources to target weights by capped water-filling, with column functions alone.

Every source has a weight and a size in words, and can be repeated a limited number of times. Targets share a total in
proportion to the weights; a source whose share lies above its cap is clamped to it, and the excess goes to the others in
proportion until no share is above. A clamped source stays clamped, as the level only rises, so a round is one aggregation
of the table of sources that yields two numbers: what is left to share, and the weight that shares it.

A source's rounded target is a number of whole repetitions of all its documents and a rest. The rest is filled by the
documents in an order drawn from seed and id; the one that crosses the border gives its first words. So a source's words add up
to its target exactly and no document is taken more often than the cap says. The border is found in two steps that
never gather a source: sizes per (source, bucket of the order) say in which bucket it lies, and the distinct rows of that bucket
alone are put in order.

A null source is a source like others, behind all others; null and blank texts have size 0. A null id counts as empty. Equal
(id, source, size) are told apart by nothing, so which of them crosses a border doesn't matter. Only id, source and text are
read, whatever other columns are called. Texts are counted whole. An empty table gives an empty table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.operators.ranking import number_rows
from assetweave.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 12  # bits of the order that name a bucket
ORDER = 60  # bits of the order
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Level:
    """Words left to share and the weight of the sources that share them."""

    words: int
    weight: int


def draw_order(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, ORDER // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, order, bucket) of every document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       draw_order(F.col("doc_id"), seed).alias("order")) \
        .withColumn("bucket", F.shiftright("order", ORDER - BUCKETS))


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources (source, source_size) with the weights in turn, by code point, null last."""
    numbered = number_rows(sources.select("source", "source_size"), F.asc_nulls_last("source"))
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    return numbered.select("source", "source_size", chosen.cast("long").alias("weight"))


def _above(cap: Column, weight: Column, level: Level) -> Column:
    """Whether the share at this level lies above the cap; exact."""
    return cap.cast(EXACT) * level.weight < weight.cast(EXACT) * level.words


def water_fill(sources: DataFrame, epochs: int, total: int | None = None) -> DataFrame:
    """Sources (source, source_size, weight) with `target`: shares of `total` (the sum of all sizes) by weight, `epochs` sizes at most."""
    cap = F.col("source_size") * epochs
    whole = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if whole[0] is None:
        return sources.withColumn("target", F.lit(0.0))
    total = min(whole[0] if total is None else total, whole[0] * epochs)
    level, before = Level(total, whole[1]), None
    while level != before and level.weight:
        clamped = sources.filter(_above(cap, F.col("weight"), level)).agg(
            F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        before, level = level, Level(total - clamped[0], whole[1] - clamped[1])
    if not level.weight:  # no weight is left to share anything
        return sources.withColumn("target", cap.cast("double"))
    share = (F.col("weight") * F.lit(level.words)).cast("double") / F.lit(float(level.weight))
    return sources.withColumn("target", F.when(_above(cap, F.col("weight"), level), cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 1, total: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, part, taken) of every document.

    A document is taken `repeats` times whole and once more with its first `part` words, if any; `taken` counts the words.
    """
    rows = cut_lineage(sized(docs, seed), "sized")
    cells = cut_lineage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "cells")
    sources = weighted(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    filled = water_fill(cut_lineage(sources, "sources"), epochs, total)
    goal = F.least(F.round("target"), F.col("source_size") * epochs).cast("long")
    repeats = F.coalesce(F.try_divide(goal - goal % F.col("source_size"), F.col("source_size")), F.lit(0)).cast("long")
    plan = filled.withColumn("goal", F.when(F.col("source_size") > 0, goal).otherwise(0)) \
        .withColumn("repeats", F.when(F.col("source_size") > 0, repeats).otherwise(0)) \
        .withColumn("rest", F.col("goal") - F.col("repeats") * F.col("source_size"))

    # the bucket in which the rest is used up: at most 2^BUCKETS rows of a source meet in this window
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = cells.withColumn("upto", F.sum("words").over(upto)).join(
        plan.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))) \
        .filter("upto >= rest").groupBy("source").agg(F.min(F.struct("bucket", F.expr("upto - words").alias("before"))).alias("b"))
    border = border.select(F.col("source").alias("_b"), F.col("b.bucket").alias("border"), F.col("b.before").alias("before"))
    plan = cut_lineage(plan.join(border, F.col("source").eqNullSafe(F.col("_b")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "repeats", "rest", "border", "before"), "mix_plan")

    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    out = ["doc_id", "source", "size", "source_size", "target", "repeats", "part"]
    sure = planned.filter("bucket <> border").withColumn("part", F.when(F.col("bucket") < F.col("border"), F.col("size")).otherwise(0))
    # equal rows of the border's bucket are counted before they are put in order
    same = ["source", "order", "doc_id", "size"]
    near = planned.filter("bucket = border").groupBy(*same, "source_size", "target", "repeats", "rest", "before").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("order", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("passed", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(earlier), F.lit(0)))
    each = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("passed") - F.col("i") * F.col("size"))))
    both = sure.select(*out).unionByName(each.select(*out))
    whole = F.col("repeats") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", whole.alias("repeats"),
                       F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(0).cast("long").alias("part"),
                       (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"))
