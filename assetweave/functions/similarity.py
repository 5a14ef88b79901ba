"""Character-sequence similarity: the one place where row values meet Python.

Spark has no Ratcliff-Obershelp ratio, so it runs as an Arrow pandas UDF. Callers first discard rows with `ratio_bound`,
a native upper bound, and where lengths say little with `subsequence_bound`, so that few rows reach the matcher.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARABLE = 8  # beyond so many times the shorter length, lengths bound the ratio well enough


def _make_ratio():
    # nested, so that it ships by value and workers need not import this package
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        # the matcher indexes its second sequence: once per distinct text of a batch, in whatever order rows come
        rows: dict[str, list[int]] = {}
        for i, b in enumerate(right):
            rows.setdefault(b, []).append(i)
        matcher, out = SequenceMatcher(), [0.0] * len(left)
        for b, mine in rows.items():
            matcher.set_seq2(b)
            for i in mine:
                matcher.set_seq1(left.iat[i])
                out[i] = matcher.ratio()
        return pd.Series(out, dtype="float64")

    # declared non-deterministic so that filters on the score do not run it a second time
    return F.pandas_udf(ratio, "double").asNondeterministic()


def _make_common():
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        """Length of the longest common subsequence, a bit per character of the left side; one pass over the right."""
        masks: dict[str, dict[str, int]] = {}
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            places = masks.get(a)
            if places is None:
                places = masks[a] = {}
                for i, c in enumerate(a):
                    places[c] = places.get(c, 0) | 1 << i
            full = free = (1 << len(a)) - 1
            for met in map(places.get, b):
                if met:
                    hit = free & met
                    free = (free + hit | free - hit) & full
            out.append(len(a) - free.bit_count())
        return pd.Series(out, dtype="Int64")

    return F.pandas_udf(common, "long").asNondeterministic()


def sequence_ratio(a: Column, b: Column) -> Column:
    return _make_ratio()(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """No alignment can match more characters than the shorter side has."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(
        F.try_divide(2.0 * F.least(la, lb), (la + lb).cast("double")))


def subsequence_bound(a: Column, b: Column) -> Column:
    """Matching blocks keep their order, so together they are a common subsequence and no longer than the longest.

    Texts much longer than `a` hold it as a subsequence anyway: there the lengths decide.
    """
    near = F.length(b) <= F.length(a) * COMPARABLE
    common = _make_common()(F.when(near, a), F.when(near, b))
    return F.least(ratio_bound(a, b), F.coalesce(F.try_divide(2.0 * common, (F.length(a) + F.length(b)).cast("double")), F.lit(1.0)))
