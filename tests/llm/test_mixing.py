import hashlib
import random
import re
from fractions import Fraction

import pytest

from assetweave.llm import mixing


def brute_targets(sizes, weights, epochs, total=None):
    """Sizes by source; rounds of clamping with fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = min(sum(sizes.values()) if total is None else total, epochs * sum(sizes.values()))
    fixed = {}
    while True:
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return {s: float(x) for s, x in fixed.items()}
        level = Fraction(total - sum(fixed.values()), sum(weight[s] for s in open_))
        over = [s for s in open_ if weight[s] * level > epochs * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (fixed | {s: weight[s] * level for s in open_}).items()}
        fixed |= {s: epochs * sizes[s] for s in over}


def brute(docs, weights=(1, 2, 3), epochs=3, seed=1, total=None):
    rows = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")),
             int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)) for i, t, s in docs]
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = brute_targets(sizes, weights, epochs, total), []
    for s in sizes:
        goal, left = int(targets[s] + 0.5), 0
        if sizes[s]:
            left = goal % sizes[s]
        for i, _, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2])):
            part = min(n, left)
            left -= part
            out.append((i, s, n, sizes[s], round(targets[s], 6), (goal // sizes[s] if sizes[s] else 0) * n + part))
    return sorted(out, key=str)


def run(spark, docs, **options):
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), **options).collect()
    for r in got:
        assert r.taken == r.repeats * r["size"] + r.part and 0 <= r.part <= r["size"]
    return sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str)


def documents(n, sources, seed=1):
    made = random.Random(seed)
    return [(i, " ".join("w" * made.randrange(1, 4) for _ in range(made.choice([0, 1, 3, 30, 300]))), made.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"weights": (5,)}, {"epochs": 1}, {"weights": (1, 50, 2), "epochs": 4}, {"total": 100}, {"total": 10**9}])
def test_against_brute_force(spark, options):
    docs = documents(300, ["a", "b", "b", "b", "b", "c", "d", "é", "😀", None])
    docs += [(1000, None, "a"), (1001, "", "only empty"), (1002, " \t\n", "only empty"), (None, "x y", "b"), (None, "x y z", "b"),
             (5, "same row", "c"), (5, "same row", "c"), (2000, "w " * 50_000, "d"), (2001, "one\x0btwo\x1fthree four", "d")]
    assert run(spark, docs, **options) == brute(docs, **options)


def test_words_of_a_source_reach_its_target(spark):
    docs = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = run(spark, docs)
    for source in {r[1] for r in got}:
        mine = [r for r in got if r[1] == source]
        assert abs(sum(r[5] for r in mine) - mine[0][4]) <= 0.5
        assert all(r[5] <= 3 * r[2] for r in mine)
    assert run(spark, docs) == got


def test_tiny_sources_are_clamped_in_rounds(spark):
    sizes = [(f"s{i:02}", 2**i) for i in range(12)]
    filled = mixing.water_fill(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, weight long"), 3)
    want = brute_targets(dict(sizes), (1,), 3)
    assert {r.source: r.target for r in filled.collect()} == pytest.approx(want)


def test_repeated_rows_without_ids_and_all_in_one_bucket(spark):
    docs = [(None, "a b c", "x")] * 50 + [(None, "a", None)] * 7
    assert run(spark, docs) == brute(docs)


def test_clashing_columns_and_empty_table(spark):
    names = ["size", "order", "bucket", "target", "weight", "rest", "n", "i", "before", "_source", "_s", "_b", "goal"]
    docs = spark.createDataFrame([(1, "a b", "s", *range(len(names)))], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    assert [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "taken").collect()] == [(1, 2, 2)]
    assert mixing.mix(docs.limit(0)).collect() == []
