"""Most similar names without comparing all of them.

A ratio of at least c between names of la and lb characters means that m >= c (la + lb) / 2 characters are matched, one to one and
in order. Put the positions of a name in the order of (rarity of the character, character, position): matched positions keep
their order on both sides, and at most la - m others stand between them. So the first k matched ones lie among the first
la - m + k positions of the one name and the first lb - m + k of the other. Their characters, read from left to right, are the
same on both sides: a signature. Names meet where a signature is equal and its ends are shifted by no more than the
unmatched characters allow. How many signatures a name has depends on k, which is chosen per pair of lengths, as large as
a limit allows; the larger, the rarer they are.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.functions.arrays import explode_computed
from assetweave.functions.similarity import ratio_bound, subsequence_bound
from assetweave.session import cut_lineage

SIGNATURES = 40  # of a name, for one class of lengths of the other; a single character may take more
LONGEST = 4  # characters of a signature
EPS = 1e-9


def _class(n: Column) -> Column:
    """Lengths in classes that grow by a tenth; short ones are on their own."""
    return F.floor(F.log(n.cast("double")) / math.log(1.1) + EPS).cast("int")


def _matched(cutoff: float, total: int) -> int:
    """Characters of each side that are matched at least, for a sum of lengths."""
    return max(1, math.ceil(cutoff * total / 2 - EPS))


def _plan(mine: list[tuple], theirs: list[tuple], cutoff: float) -> list[tuple]:
    """(own class, their class, own least length, their least length, k) of the classes that can reach the cutoff."""
    out = []
    for a, a_low, a_high in mine:
        for b, b_low, b_high in theirs:
            def fits(x: int, y: int) -> bool:
                return min(x, y) >= cutoff * (x + y) / 2 - EPS
            near = (a_high, b_low) if a_high < b_low else (a_low, b_high) if b_high < a_low else (a_low, a_low)
            if not fits(*near):
                continue
            sizes = range(min(LONGEST, _matched(cutoff, a_low + b_low)), 0, -1)

            def count(k: int) -> int:
                sides = ((a_high, _matched(cutoff, a_high + b_low)), (b_high, _matched(cutoff, a_low + b_high)))
                return max(math.comb(min(n, max(n - m, 0) + k), k) for n, m in sides)
            out.append((a, b, a_low, b_low, next((k for k in sizes if count(k) <= SIGNATURES), 1)))
    return out


def _subsequences(places: Column, k: int) -> Column:
    """All k places in order, as (text, first, last)."""
    built = F.transform(places, lambda x: F.struct(x["ch"].alias("s"), x["at"].alias("first"), x["at"].alias("last")))
    for _ in range(k - 1):
        built = F.flatten(F.transform(built, lambda y: F.transform(
            F.filter(places, lambda x: x["at"] > y["last"]),
            lambda x: F.struct(F.concat(y["s"], x["ch"]).alias("s"), y["first"].alias("first"), x["at"].alias("last")))))
    return built


def _signatures(ordered: DataFrame, plan: DataFrame, cutoff: float) -> DataFrame:
    """(low, n, class, other, s, first, last); `plan` has class, other, other_low and k."""
    n = F.col("n")
    matched = F.greatest(F.ceil(cutoff * (n + F.col("other_low")) / 2 - EPS), F.lit(1)).cast("int")
    able = ordered.join(plan, "class").withColumn("matched", matched).filter("matched <= n")
    # in the order of their places, of the same rarity order on both sides
    first = F.array_sort(F.transform(F.slice("places", 1, F.least(n, n - F.col("matched") + F.col("k"))),
                                     lambda p: F.struct(p["at"].alias("at"), p["ch"].alias("ch"))))
    built = F.when(F.col("k") == 1, _subsequences(F.col("first"), 1))
    for k in range(2, LONGEST + 1):
        built = built.when(F.col("k") == k, _subsequences(F.col("first"), k))
    return explode_computed(able.withColumn("first", first), F.array_distinct(built), "_s", "low", "n", "class", "other").select(
        "low", "n", "class", "other", "_s.*")


def _places(lows: DataFrame) -> DataFrame:
    return lows.select("low", F.posexplode(F.regexp_extract_all("low", F.lit("(?s)."), F.lit(0))).alias("at", "ch"))


def candidate_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Distinct (a, b) of left(low) and right(low) that share a signature; both hold distinct texts."""
    places = [cut_lineage(_places(df), "places") for df in (left, right)]
    rare = places[0].unionAll(places[1]).groupBy("ch").agg(F.count("*").alias("freq"))
    ordered = [cut_lineage(p.join(rare, "ch").groupBy("low").agg(F.array_sort(F.collect_list(F.struct("freq", "ch", "at"))).alias("places"))
                           .withColumn("n", F.size("places")).withColumn("class", _class(F.col("n"))), "ordered") for p in places]
    # a class per tenth of length: some dozens, whatever the number of names
    known = [[tuple(r) for r in o.groupBy("class").agg(F.min("n"), F.max("n")).collect()] for o in ordered]
    spark, plan = left.sparkSession, _plan(*known, cutoff)
    if not plan:
        return left.select(F.col("low").alias("a"), F.col("low").alias("b")).limit(0)
    one = spark.createDataFrame([(a, b, b_low, k) for a, b, _, b_low, k in plan], "class int, other int, other_low int, k int")
    other = spark.createDataFrame([(b, a, a_low, k) for a, b, a_low, _, k in plan], "class int, other int, other_low int, k int")
    a = _signatures(ordered[0], one, cutoff).select(F.col("low").alias("a"), F.col("n").alias("an"), F.col("class").alias("ac"),
                                                    F.col("other").alias("bc"), "s", F.col("first").alias("af"), F.col("last").alias("al"))
    b = _signatures(ordered[1], other, cutoff).select(F.col("low").alias("b"), F.col("n").alias("bn"), F.col("other").alias("ac"),
                                                      F.col("class").alias("bc"), "s", F.col("first").alias("bf"), F.col("last").alias("bl"))
    matched = F.ceil(cutoff * (F.col("an") + F.col("bn")) / 2 - EPS)
    fits = matched <= F.least("an", "bn")
    for x, y in (("af", "bf"), ("al", "bl")):
        shift = F.col(y) - F.col(x)
        fits = fits & (shift >= matched - F.col("an")) & (shift <= F.col("bn") - matched)
    return a.join(b, ["ac", "bc", "s"]).filter(fits).select("a", "b").distinct()


def likely_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Candidates whose longest common subsequence still allows the ratio."""
    pairs = candidate_pairs(left, right, cutoff).filter(ratio_bound(F.col("a"), F.col("b")) >= cutoff - EPS)
    return pairs.withColumn("_most", subsequence_bound(F.col("a"), F.col("b"))).filter(F.col("_most") >= cutoff - EPS).drop("_most")
