"""Columns that are called like the operators' own."""

import re

import pytest
from pyspark.sql import functions as F

from assetweave.llm import common, decontaminate, embedding, line_dedup, minhash

TEXTS = [(1, "a b\nc d\ne f"), (2, "x\na b\nc d\ne f"), (3, "one two three four five six seven eight nine ten eleven"),
         (4, "one two three four five six seven eight nine ten eleven"), (4, "one two three four five six seven eight nine ten eleven"),
         (5, None), (6, ""), (7, "a b\nc d\ne f"), (None, "some other words stand here and nowhere else at all")]


def helpers(module):
    """Every name that the operator's source gives to a column."""
    with open(module.__file__, encoding="utf-8") as f, open(common.__file__, encoding="utf-8") as g:
        told = set(re.findall(r"[\"'](_?[a-z][a-z_0-9]*)[\"']", f.read() + g.read()))
    return sorted(told - {"doc_id", "text", "vec_id", "embedding"})


def with_clashes(df, module):
    names = helpers(module)
    assert len(names) > 10
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)], F.lit(1).alias("a.b"))


@pytest.mark.parametrize("module, stage", [
    (line_dedup, line_dedup.drop_repeated), (minhash, minhash.drop_near_duplicates),
    (decontaminate, lambda docs: decontaminate.drop_contaminated(docs, docs.sparkSession.createDataFrame(
        [(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")))])
def test_stages(spark, module, stage):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    clashing = with_clashes(docs, module)
    got, want = stage(clashing), sorted((tuple(r) for r in stage(docs).collect()), key=str)
    assert got.columns == clashing.columns and len(want) < len(TEXTS)
    found = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == want
    assert all(list(r)[2:] == [*range(len(r) - 3), 1] for r in found)
    assert stage(clashing.limit(0)).collect() == []


def test_queries(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    pairs = [(line_dedup, lambda d: line_dedup.dedup_lines(d).select("doc_id", "text", "_lines", "_removed")),
             (minhash, lambda d: minhash.near_duplicates(d).select("doc_id", "class_id", "kept"))]
    for module, query in pairs:
        assert sorted(map(str, query(with_clashes(docs, module)).collect())) == sorted(map(str, query(docs).collect()))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    assert sorted(map(str, embedding.link_vectors(with_clashes(vectors, embedding)).collect())) == sorted(map(str, embedding.link_vectors(vectors).collect()))
