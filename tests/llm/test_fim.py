import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetweave.llm import fim

MARKS = fim.Sentinels()


def brute(doc_id, text, pattern=None, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    begins = list(range(len(text))) if pattern is None else [m.start() for m in re.finditer(pattern, text) if m.group()]
    if text and (not begins or begins[0]):
        begins = [0, *begins[1:]] if begins else [0]
    begins.append(len(text))
    n = len(begins) - 1
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = begins[a], begins[b]
    if not text or any(x in text for x in MARKS.all()) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 100, 3000])
def test_every_rank_is_reached(n):
    made = random.Random(n)
    points = np.array([made.randrange(1, 9) for _ in range(n)], np.int64)
    units = fim.SkipList(points)
    ends = [0, *np.cumsum(points).tolist()]
    assert [units.point(r) for r in range(n + 1)] == ends


def test_lanes_are_short():
    units = fim.SkipList(np.ones(1_000_000, np.int8))
    sizes = [len(passed) for _, passed, _ in units._lanes]
    assert len(sizes) > 6 and sizes[-1] < 40
    assert all(0.2 < b / a < 0.3 for a, b in zip(sizes[:5], sizes[1:6], strict=True))
    assert [units.point(r) for r in (0, 1, 499_999, 1_000_000)] == [0, 1, 499_999, 1_000_000]


def texts():
    made = random.Random(3)
    rows = [(i, "".join(made.choice("ab \n😀é<PSM>") for _ in range(made.randrange(40)))) for i in range(300)]
    return rows + [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "<S"), (None, "no id"), (None, None), (1004, "x" * 300_000),
                   (7, "twice"), (7, "twice"), (1005, "é́‍👩‍👩" * 50)]


@pytest.mark.parametrize("pattern", [None, r"\w+", r"\s*\S+"])
def test_against_brute_force(spark, pattern):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = fim.fill_in_middle(docs, unit=pattern).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    plain = lambda r: (r is None, r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(
        ((i, *brute(i, t, pattern)) for i, t in texts()), key=str)
    assert sorted((r.back for r in got), key=plain) == sorted((t or "" for _, t in texts()), key=plain)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels_and_shares(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(200)], "doc_id long, text string")
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    got = fim.fill_in_middle(docs, percent=100, spm_percent=100, sentinels=marks).withColumn("back", fim.restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and {r.back for r in got} == {"one two three"}
    assert all(r.output.startswith("[suf]") for r in got)


def test_clashing_columns_and_empty_table(spark):
    names = "n int, form int, cut int, a int, b int, whether int, which int, output int"
    docs = spark.createDataFrame([(1, "abc", *range(8))], f"doc_id long, text string, {names}")
    got = fim.fill_in_middle(docs).collect()
    assert len(got) == 1 and (got[0].n, got[0].form, got[0].prefix_chars, got[0].middle_chars, got[0].output) == brute(1, "abc")
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
