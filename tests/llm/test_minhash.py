import random

import numpy as np
import pytest

from assetweave.llm import minhash as d


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.class_id, set()).add(r.doc_id)
    return {frozenset(x) for x in out.values()}


def brute(docs, idf, similarity=0.8):
    """Classes by comparing all pairs."""
    sets = {i: d.shingles(t or "", idf) for i, t in docs}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if len(sets[a][0]) and d.weighted_jaccard(sets[a], sets[b]) >= similarity:
                label[max(top(a), top(b))] = min(top(a), top(b))
    out = {}
    for i in ids:
        out.setdefault(top(i), set()).add(i)
    return {frozenset(x) for x in out.values()}


def corpus():
    made = random.Random(7)
    word = lambda: "".join(made.choice("abcdefgh") for _ in range(made.randrange(2, 6)))
    base = [[word() for _ in range(made.randrange(60, 300))] for _ in range(25)]
    docs = []
    for k, b in enumerate(base):
        for c in range(made.choice([1, 1, 2, 6])):
            w = list(b)
            for _ in range(made.choice([0, 1, 2, 3])):
                w[made.randrange(len(w))] = word()
            docs.append((k * 100 + c, " ".join(w)))
    shared = " ".join(word() for _ in range(40))
    docs += [(5000 + i, shared + " " + " ".join(word() for _ in range(120))) for i in range(10)]
    docs += [(6000, None), (6001, ""), (6002, ""), (6003, "one two"), (6004, "One two!"), (6005, "!!"), (6006, "!!")]
    docs += [(7000, " ".join(base[0] * 40)), (7001, " ".join(base[0] * 40) + " end")]
    return docs


@pytest.mark.parametrize("block", [500, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = d.near_duplicates(df).collect()
    assert groups(got) == brute(docs, d.inverse_frequencies(df))
    assert sum(r.kept for r in got) == len(groups(got))
    assert all(r.class_id == r.doc_id for r in got if r.kept)


def test_similarity_of_copies_is_found_at_the_threshold(spark):
    """Copies with 0.82 and more in unweighted shingles are caught, in a large group as well."""
    made = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    docs = [(0, " ".join(base))]
    for i in range(1, 200):
        w = list(base)
        for p in made.sample(range(0, 400, 8), 8):  # 40 of 396 shingles differ
            w[p] = f"n{i}x{p}"
        docs.append((i, " ".join(w)))
    got = d.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert groups(got) == {frozenset(range(200))}


def test_sampling_follows_weighted_jaccard():
    made = np.random.default_rng(4)
    sampler = d.Sampler(bands=400, rows=1)
    mark = np.sort(made.integers(1, 2**63, 300).astype(np.uint64))
    a, b = made.random(300) + 0.2, made.random(300) + 0.2
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = (sampler.band_keys(mark, a) == sampler.band_keys(mark, b)).mean()
    assert abs(same - want) < 0.1
    assert (sampler.band_keys(mark, a) == sampler.band_keys(mark, a)).all()


def test_filter_keeps_one_of_each_class_with_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (None, "a b c d e f", 3), (3, "other words here", 4),
                                  (3, "other words here", 4), (4, None, 5), (5, "", 6)], "doc_id long, text string, node int")
    kept = d.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.near_duplicates(df).count() == 0 and d.drop_near_duplicates(df).count() == 0
