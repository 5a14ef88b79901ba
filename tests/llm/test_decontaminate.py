import random
import re

import pytest

from assetweave.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for s in range(max(len(q) - size, 0) + 1) if q else ():
                win = q[s:s + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc_id, len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string"), **kw)
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    made = random.Random(3)
    vocabulary = ["Ab", "b", "cÉ", "d1", "é", "x", "The"]
    text = lambda n: "".join(made.choice(vocabulary) + made.choice([" ", "  ", "-", ".\n", ", "]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30, 5, 12])] + [(20, None), (21, ""), (22, "!!"), (None, "only here")]
    items += [(30, items[7][1]), (30, items[7][1])]
    docs = [(i, text(made.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"Zz {text(3)} {items[i][1]} {text(4)}") for i in range(10)]
    docs += [(200, None), (201, ""), (None, "only HERE"), (202, items[7][1]), (202, items[7][1]), (203, "a" * 50_000 + " " + items[7][1] * 20)]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("limit", [1, 3])
def test_blocks_give_the_same(spark, monkeypatch, limit):
    docs, items = [(1, "a b c d e f g h i j k l m"), (2, "z y x"), (3, "q")], [(1, "a b c d e f g h i j k l"), (2, "y x"), (3, "q")]
    monkeypatch.setattr(d, "LITERAL_LIMIT", limit)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, "", False)]


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.sql("select 1L doc_id, 'one two three' text, 5 row, 'k' anchor, 9 finds union all select 2L, 'clean words', 6, 'l', 8 union all select 3L, null, 7, 'm', 7")
    bench = spark.sql("select 1L item_id, 'Two three' text, 'x' window")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_main_path_is_native(spark):
    docs = spark.sql("select 1L doc_id, 'one two three' text")
    plan = d.decontaminate(docs, spark.sql("select 1L item_id, 'two three' text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
