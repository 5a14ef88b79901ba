"""Exact substring joins without comparing every pair.

A string can only occur inside another one if each of its grams does. Every needle is
looked up by one gram, the one fewest other needles share, and the candidates that meet
it are verified inside the join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.functions.arrays import explode_computed
from assetweave.session import cut_lineage, task_count

GRAM_SIZES = (1, 2, 3, 5)


def grams(c: Column, size: int) -> Column:
    """All substrings of one length, overlapping, in order."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _lookup_size(c: Column) -> Column:
    out = F.lit(GRAM_SIZES[0])
    for size in GRAM_SIZES[1:]:
        out = F.when(F.length(c) >= size, size).otherwise(out)
    return out


def substring_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, hay, ...) for every distinct non-empty needle contained in a distinct hay.

    `needles` has the column `needle`; `haystacks` has `hay` and may carry more columns.
    Both are expected to be vocabularies: distinct words or names, not the rows they came
    from.
    """
    size = _lookup_size(F.col("needle"))
    by_size = F.array_distinct(F.coalesce(*[
        F.when(size == k, grams(F.col("needle"), k)) for k in GRAM_SIZES]))
    own = explode_computed(needles.filter(F.length("needle") > 0), by_size, "gram", "needle")
    shared = own.groupBy("gram").agg(F.count("*").alias("n_needles"))
    # written out, so that its real size decides whether the grams of the haystacks move
    lookup = cut_lineage(own.join(shared, "gram").groupBy("needle")
                         .agg(F.min(F.struct("n_needles", "gram")).alias("best"))
                         .select("needle", F.col("best.gram").alias("gram")), "grams")
    spread = haystacks.repartition(task_count(haystacks.sparkSession), "hay")
    hay_grams = explode_computed(spread, F.array_distinct(F.concat(
        *[grams(F.col("hay"), k) for k in GRAM_SIZES])), "gram", *haystacks.columns)
    return (hay_grams.join(lookup, "gram").filter(F.contains("hay", F.col("needle")))
            .select("needle", *haystacks.columns))
