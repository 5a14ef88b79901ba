import random

import pytest

from assetweave.llm import quality as d

LABELS = "doc_id long, quality int, toxic int"


def corpus(documents, spark, n=600):
    made = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        w = [made.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(made.randrange(10, 80))]
        kind = i % 10
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w.insert(made.randrange(len(w)), made.choice(["nasty", "vile"]))
        rows.append((i, " ".join(w), "en"))
        if i % 3 != 2:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return documents(*rows), spark.createDataFrame(labels, LABELS), rows


def test_junk_and_toxic_texts_are_caught_and_clean_ones_kept(spark, documents):
    docs, labels, rows = corpus(documents, spark)
    got = {r.doc_id: r for r in d.score(docs, d.learn(docs, labels)).collect()}
    unseen = [i for i in range(600) if i % 3 == 2]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 600
    right = sum(got[i].kept == (i % 10 > 1) for i in unseen) / len(unseen)
    assert right >= 0.95


def test_views_teach_each_other(spark, documents):
    """With few labels, what the metadata view is sure of widens what the text view knows."""
    made = random.Random(3)
    rows = [(i, " ".join(made.choice((["up", "high"] if i % 2 else ["down", "low"]) + ["the"]) for _ in range(20)), "en") for i in range(400)]
    docs = documents(*rows).withColumn("source", (docs_id() % 2).cast("string"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    got = d.score(docs, d.learn(docs, labels)).collect()
    assert sum(r.kept == bool(r.doc_id % 2) for r in got) / 400 >= 0.97


def docs_id():
    from pyspark.sql import functions as F
    return F.col("doc_id")


def test_odd_rows(spark, documents):
    docs, labels, _ = corpus(documents, spark, 200)
    more = spark.createDataFrame([(None, 1, 0), (9999, 0, 0), (1, None, None), (3, 1, None), (3, 1, None)], LABELS)
    odd = documents((1000, None), (1001, ""), (None, "x"), (3, "again"), (1002, "word " * 50_000)).withColumn("source", docs_null())
    all_docs = docs.unionByName(odd)
    got = d.score(all_docs.withColumn("score", docs_id()).withColumn("good", docs_id()), d.learn(all_docs, labels.union(more))).collect()
    assert len(got) == 205


def docs_null():
    from pyspark.sql import functions as F
    return F.lit(None).cast("string")


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(0, 1, 0), (1, 1, 0)], 1.0)])
def test_without_both_classes(spark, documents, labels, want):
    docs = documents((0, "a"), (1, "b"))
    model = d.learn(docs, spark.createDataFrame(labels, LABELS))
    assert {r.score for r in d.score(docs, model).collect()} == {want}
    assert d.score(documents(), model).count() == 0


def test_all_unlabelled_documents_teach(spark, documents):
    """A rare source without labels gets its weight from the texts, wherever in the corpus its documents lie."""
    from pyspark.sql import functions as F
    made = random.Random(4)
    rows = [(i, " ".join(made.choice((["down", "low"] if i % 2 == 0 or i > 8000 else ["up", "high"]) + ["the"]) for _ in range(20)), "en")
            for i in range(8006)]
    source = F.when(docs_id() > 8000, "rare").otherwise("s")
    docs = documents(*rows).withColumn("source", source)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    weights = d.learn(docs, labels).meta.weights
    at = set(d.meta_features("en", "rare", 100)) - set(d.meta_features("en", "s", 100))
    assert len(at) == 1 and weights[at.pop()] < -0.2


def test_every_telling_word_is_kept():
    import numpy as np
    y = np.arange(200) % 10 != 0
    common = [np.arange(1500) if good else np.zeros(0, int) for good in y]  # words of good documents
    rare = [np.append(w, [2000] if i in (0, 10, 20) else []).astype(int) for i, w in enumerate(common)]
    assert d.telling_words(rare, y.astype(float), 4.0).tolist() == [*range(1500), 2000]


def test_features_equal_their_definition(monkeypatch):
    """Style and words of texts, computed chunk by chunk with string methods."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    from assetweave.llm import words
    made = random.Random(2)
    texts = [None, "", "  ", "ABC abc Abc a1 !! x-y-z É É1 ǅ ǅA 日本 ١٢ ²", *[" ".join("".join(made.choice("aB1-É ß") for _ in range(made.randrange(1, 9)))
                                                                     for _ in range(made.randrange(30))) for _ in range(40)]]
    for size in (20, 10**6):
        monkeypatch.setattr(words.slices, "__defaults__", (size,))
        for text, (found, style) in zip(texts, d.text_features(pa.array(texts)), strict=True):
            chunks = (text or "").split()
            bare = ["".join(c for c in x if c.isalnum()) for x in chunks]
            marks = {xxhash.xxh64_intdigest(w.lower()) % d.FEATURES for w in bare if w}
            assert found.tolist() == sorted(marks)
            looks = [[len(w) > 1 and w.isupper(), not w, len(c) - len(w) > 1, any(map(str.isdigit, c)), min(sum(map(str.isalpha, c)), 20) / 10,
                      (len(c) - len(w)) / len(c)] for c, w in zip(chunks, bare, strict=True)]
            want = [*(np.mean(looks, axis=0) if looks else [0] * 6), len(marks | ({-1} if "" in bare else set())) / max(1, len(chunks)), np.log1p(len(chunks)) / 10]
            assert np.allclose(style, want, atol=1e-5)


def test_scores_from_kept_features_equal_a_second_reading(spark, documents):
    docs, labels, _ = corpus(documents, spark, 300)
    docs = docs.unionByName(documents((7, "alpha beta"), (None, None), (7, "alpha beta")))
    def told(df):
        return sorted((str(r.doc_id), round(r.score, 9), round(r.text_score, 9), r.kept) for r in df.collect())
    assert told(d.learn_and_score(docs, labels)) == told(d.score(docs, d.learn(docs, labels)))
    assert told(d.learn_and_score(docs, labels.limit(0))) == told(d.score(docs, d.learn(docs, labels.limit(0))))
