"""Fill-in-the-middle: texts cut at two ranks and put together as prefix, suffix and middle under sentinels.

A text is a sequence of units: its code points, or the matches of a pattern with what stands between them. An indexable skip
list holds the units in express lanes. Every link carries how many units and how many code points it passes, so a descent
by accumulated widths reaches the code point at which a unit begins. Only the cuts come from Python; texts are put
together, and taken apart again, by column functions.

Cuts and form follow from the seed and the id alone. A null id counts as empty, a null text as the empty text; empty texts
and texts that hold a sentinel stay plain, as their parts couldn't be told apart again. Rows with equal id and text get
equal results, cuts that tie give an empty middle, an empty table gives an empty table, and other columns play no part.
Texts of any length are cut whole; memory is linear in the longest text of a batch.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE_BITS = 2  # a link of one lane goes over about four of the lane below


@dataclass(frozen=True)
class Sentinels:
    """None may lie in another, and no end of one may begin another: then a cut can't make one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class SkipList:
    """Units of a text behind lanes of links; `points` are the code points of each unit."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.units, self.points = n, int(points.sum())
        # lane 0 links every unit to the next; what a link passes is summed up lane by lane
        self._lanes = [(None, points, None)]
        drawn = np.arange(n, dtype=np.uint32) * np.uint32(0x9E3779B1)
        ranks, passed, top = None, points, 32 - LANE_BITS
        while len(passed) > 1 << LANE_BITS and top >= 0:
            at_rank = drawn if ranks is None else drawn[ranks]
            kept = at_rank < np.uint32(1 << top)
            kept[0] = True  # every lane begins at the head
            down = np.flatnonzero(kept)
            ranks = down if ranks is None else ranks[down]
            passed = np.add.reduceat(passed, down, dtype=np.int64)
            self._lanes.append((np.diff(ranks, append=n), passed, down))
            top -= LANE_BITS

    def point(self, rank: int) -> int:
        """The code points before the unit of this rank, 0 <= rank <= units."""
        if rank == self.units:
            return self.points
        at = units = points = 0
        for over, passed, down in reversed(self._lanes):
            while (step := 1 if over is None else int(over[at])) + units <= rank:
                units, points, at = units + step, points + int(passed[at]), at + 1
            if down is not None:
                at = int(down[at])
        return points


def unit_points(text: str, pattern: re.Pattern | None) -> np.ndarray:
    """Code points of each unit. What no match covers belongs to the unit before it, or to the first."""
    if pattern is None:
        return np.ones(len(text), np.int8)
    begins = [m.start() for m in pattern.finditer(text) if m.end() > m.start()]
    if not begins:
        return np.array([len(text)] if text else [], np.int64)
    return np.diff(np.array([0, *begins[1:], len(text)], np.int64))


def _cuts(pattern: str | None):
    def cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = None if pattern is None else re.compile(pattern)
        for texts, first, second in parts:
            found = np.zeros((3, len(texts)), np.int64)
            for i, (text, a, b) in enumerate(zip(texts, first, second, strict=True)):
                units = SkipList(unit_points(text, unit))
                low, high = sorted((a % (units.units + 1), b % (units.units + 1)))
                found[:, i] = units.units, units.point(low), units.point(high)
            yield pd.DataFrame(dict(zip(("units", "begin", "end"), found, strict=True)))
    cuts.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(cuts, "units long, begin long, end long").asNondeterministic()


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """Numbers from 0 to 2^32 - 1 out of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str | None = None,
                   sentinels: Sentinels = Sentinels()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; n counts units.

    `percent` of the documents are rearranged, `spm_percent` of these with the suffix first. `unit` is the pattern of a unit
    (Python syntax, over code points); without it every code point is one.
    """
    a, b, whether, which = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), a.alias("a"), b.alias("b"), (whether % 100).alias("whether"),
                      (which % 100).alias("which")).withColumn("cut", _cuts(unit)("text", "a", "b"))
    plain = (F.col("text") == "") | (F.col("whether") >= percent)
    for mark in sentinels.all():
        plain = plain | F.contains("text", F.lit(mark))
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.col("which") < spm_percent, "spm").otherwise("psm"))
    begin, end = F.col("cut.begin").cast("int"), F.col("cut.end").cast("int")
    prefix, middle = F.substring("text", F.lit(1), begin), F.substring("text", begin + 1, end - begin)
    suffix = F.substring("text", end + 1, F.length("text"))
    p, s, m = (F.lit(x) for x in sentinels.all())
    output = (F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    moved = F.col("form") != "plain"
    return cut.select("doc_id", F.col("cut.units").alias("n"), "form", F.when(moved, F.col("cut.begin")).alias("prefix_chars"),
                      F.when(moved, F.col("cut.end") - F.col("cut.begin")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text before its rearrangement; no part holds a sentinel, so these alone divide it."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels.all()))
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
