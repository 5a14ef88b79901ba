import os
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from test_decontaminate import brute as contaminated
from test_line_dedup import brute as lines
from test_minhash import brute as classes

from assetweave.llm import minhash, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BENCH = [(1, "which of the seven rivers in the north carries most water in the spring of the year"), (2, "short one")]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df, sql = entry.queries()[name](spark, SF_DIR), queries.oracle_sql().get(name)
    if sql:
        assert compare(df, connect(SF_DIR), sql) is None
    else:
        assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    got = queries.queries()["op1_language_id"](spark, SF_DIR).filter("held_out").alias("g")
    docs = queries.table(spark, SF_DIR, "documents").filter("lang is not null").alias("d")
    both = got.join(docs, "doc_id").selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    assert both >= 0.97


def fixture(tmp_path, spark):
    made = random.Random(11)
    speak = {"en": "the house and river with those people going home through water over there".split(),
             "fr": "le château était avec les élèves pour manger une très belle pomme dans".split()}
    rows = []
    for i in range(60):
        lang = ["en", "fr"][i % 2]
        say = lambda n, lang=lang: " ".join(made.choice(speak[lang]) for _ in range(n))
        rows.append([i, "\n".join(say(made.randrange(8, 20)) for _ in range(made.randrange(2, 9))), lang])
    passage = "\n".join(rows[0][1].split("\n")[:1] + ["a line that comes again", "and one more of them", "and the last one"])
    for i in (7, 8, 9):
        rows[i][1] += "\n" + passage
    rows += [[100, rows[3][1].replace("\n", " ") + " end", "fr"], [101, rows[3][1].replace("\n", " "), "fr"], [102, "?! 12", "en"], [103, None, "en"],
             [104, rows[5][1] + " Which of the seven RIVERS in the north carries most water", "fr"], [105, rows[4][1], "en"]]
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return [(i, t) for i, t, _ in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = fixture(tmp_path, spark)
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    docs = [(i, t) for i, t, n, gone in lines(docs) if not n or gone < n]
    idf = minhash.inverse_frequencies(spark.createDataFrame(docs, "doc_id long, text string"))
    first = {min(g) for g in classes(docs, idf)}
    docs = [(i, t) for i, t in docs if i in first]
    bad = {r[0] for r in contaminated(docs, BENCH) if r[4]}
    docs = dict((i, t) for i, t in docs if i not in bad)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, total = defaultdict(list), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length))
        total[r.doc_id] = r.doc_tokens
    assert {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in docs.items()} == total
    for parts in got.values():
        at = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == at[:-1].tolist()


def test_stages_return_documents(spark, tmp_path):
    fixture(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names and docs.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
