import numpy as np
import pytest

from assetweave.llm import embedding as d


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64) / np.linalg.norm(v)
    links = {k: set() for k in ok}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and (ids[a] != ids[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
    low = {k: ids[k] for k in ok}
    for _ in rows:
        for k in ok:
            low[k] = min([low[k], *(low[j] for j in links[k])])
    return sorted(((i, len({ids[j] for j in links.get(k, ())}), low.get(k, i), i is None or low.get(k, i) == i) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in d.link_vectors(df, **kw).collect()), key=str)


def vectors(n=300, size=16, seed=0):
    made = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        x = made.standard_normal(size)
        for _ in range(int(made.choice([1, 1, 2, 5, 30]))):
            rows.append((len(rows), [float(np.float32(v)) for v in x + 0.1 * made.standard_normal(size)]))
    return rows


ODD = [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, []), (None, [1.0] * 16),
       (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]


@pytest.mark.parametrize("leaf, block", [(256, 1024), (20, 8)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(d, "BLOCK", block)
    rows = vectors() + ODD
    rows += [(2000 + i, rows[0][1]) for i in range(5)]  # equal vectors
    got, want = run(spark, rows, leaf=leaf), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    same = sum(a == b for a, b in zip(got, want))
    assert same >= (1.0 if leaf == 256 else 0.95) * len(want)


def test_no_link_is_counted_twice_with_spill(spark):
    rows = vectors(120, seed=3)
    assert run(spark, rows, leaf=20, spill=5.0) == brute(rows)


def test_model_stays_bounded_but_leaves_keep_their_size():
    made = np.random.default_rng(1)
    x = made.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = d.grow(x[:200], 4000, 20, made)
    rows, leaves = d.leaves_of(x, tree, 3, 0.0)
    assert sorted(rows.tolist()) == list(range(4000))
    assert np.median(np.unique(leaves, return_counts=True)[1]) <= 60


def test_repeated_rows_and_empty_table(spark):
    one = [1.0] * 16
    assert run(spark, [(1, one), (1, one), (2, one)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == [(5, 0, 5, True)]


def hot_third(n, typical=0.92, size=64):
    """A third of the vectors are one group with that cosine between two of them."""
    made = np.random.default_rng(5)
    x = made.standard_normal((n, size))
    x[:n // 3] = np.sqrt(typical) * x[0] / np.linalg.norm(x[0]) + np.sqrt((1 - typical) / size) * x[:n // 3]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("total", [50_000, 1_000_000])
def test_recall_in_a_hot_group_holds_at_any_size(total):
    x, made = hot_third(6000), np.random.default_rng(2)
    margin = d.SPILL * np.sqrt(0.2 / 64)
    a, b = made.integers(1, 2000, (2, 3000))
    ok = (a != b) & ((x[a] * x[b]).sum(axis=1) >= 0.9)
    a, b = a[ok], b[ok]
    met = np.zeros(len(a), bool)
    for i in range(d.trees_for(total, d.LEAF, d.TREES)):
        tree = d.grow(x[made.choice(6000, 3000, replace=False)], total, d.LEAF, made, margin, 0.9)
        left, right = ({*zip(*(v.tolist() for v in d.leaves_of(x[k], tree, i, margin)), strict=True)} for k in (a, b))
        met[[r for r, _ in left & right]] = True
    assert met.mean() >= 0.98


def test_trees_follow_from_depth():
    assert d.trees_for(1000, 256, 12) == d.trees_for(50_000, 256, 12) == 12
    assert d.trees_for(10**9, 256, 12) > 12


def test_members_of_dense_leaves_count_once(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 8)
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(hot_third(240, size=16))]
    got, want = run(spark, rows, leaf=10), brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) > 0
