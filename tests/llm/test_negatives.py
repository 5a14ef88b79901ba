import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetweave.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every, search=N.Search()):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(search.scale * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = sorted(((sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a), key=lambda s: (-s[0], s[1]))
        for score, p, _ in [s for s in scores if s[2] == label][:search.positives]:
            fit = [s for s in scores if s[2] != label and search.low * score <= 100 * s[0] <= search.high * score]
            out += [(a, p, k + 1, n, score, s) for k, (s, n, _) in enumerate(fit[:search.negatives])]
    return sorted(out)


def run(spark, rows, every, search=N.Search()):
    got = N.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0, search)
    return sorted(tuple(r) for r in got.collect())


def clustered(n, dims, labels, seed=1):
    made = np.random.default_rng(seed)
    centres = made.standard_normal((5, dims))
    return [(i, int(made.integers(labels)), (centres[made.integers(5)] * made.random() + 0.4 * made.standard_normal(dims)).tolist()) for i in range(n)]


def test_intervals_hold_the_scores(spark):
    rows = clustered(400, 24, 3)
    codes, dims, _ = N.coded(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    block, turn = N.Block(codes.toArrow(), dims), N._isometry(dims, N.Search().seed)
    queries = np.concatenate([block.vectors[:50], np.zeros((1, dims), np.int64)])
    guess, low, high = block.intervals(queries, turn, 0, len(block.ids))
    scores = queries @ block.vectors.T
    assert (low <= scores).all() and (scores <= high).all()
    width = (high - low)[:50] / 2 / (np.linalg.norm(queries[:50], axis=1)[:, None] * block.norm)
    assert width.mean() < 0.35 and np.corrcoef(guess[:50].ravel(), scores[:50].ravel())[0, 1] > 0.95


@pytest.mark.parametrize("dims,labels", [(64, 10), (3, 2), (100, 1), (1, 3)])
def test_against_brute_force(spark, dims, labels):
    rows = clustered(300, dims, labels)
    assert run(spark, rows, 5) == brute(rows, 5)


def test_other_numbers_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST", 40)
    rows, search = clustered(500, 16, 4, 2), N.Search(positives=2, negatives=7, low=10, high=100)
    assert run(spark, rows, 3, search) == brute(rows, 3, search)


def test_ties_repeats_nulls_and_odd_rows(spark):
    made = random.Random(4)
    rows = [(i, made.randrange(3), [made.choice([0.0, 0.25, 0.5]) for _ in range(made.choice([2, 3]))]) for i in range(200)]
    rows += rows[:40] + [(0, 9, [9.0]), (3, 0, [0.1, 0.1])]
    rows += [(500, None, [1.0]), (505, 1, None), (510, 1, [1.0, None]), (515, 1, [float("nan")]), (520, 1, [float("inf")]),
             (None, 1, [1.0]), (525, 1, []), (530, 2, [0.0, 0.0]), (535, -1, [-1.0, -1.0]), (540, 1, [1e-9])]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_large_components_are_exact(spark):
    made = random.Random(6)
    for size in (1e5, 3e6):
        rows = [(i, i % 2, [made.uniform(-size, size) for _ in range(4)]) for i in range(60)]
        assert run(spark, rows, 4) == brute(rows, 4)


def test_too_large_components_fail_loudly(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, 1, [1e300]), (1, 1, [1.0])], 2)


def test_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame(clustered(60, 4, 2), SCHEMA)
    extra = rows.selectExpr("*", *[f"1 AS {c}" for c in ("anchor", "ints", "block", "score", "rank", "kind", "wanted", "code")])
    anchors = F.col("vec_id") % 5 == 0
    assert sorted(N.hard_negatives(extra, anchors).collect()) == sorted(N.hard_negatives(rows, anchors).collect())
    assert N.hard_negatives(rows.limit(0), anchors).collect() == []
    assert N.hard_negatives(rows, F.lit(False)).collect() == []
    assert N.hard_negatives(rows, F.lit(None).cast("boolean")).collect() == []
