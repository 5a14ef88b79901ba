import random

from assetweave.llm import line_dedup as d


def brute(docs, size=3):
    """Documents are (doc_id, text) with distinct ids."""
    filled, seen, gone = {}, {}, {}
    for doc_id, text in sorted((x for x in docs if x[1] is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(d.SPACE)]
        filled[doc_id] = at
        for i in range(len(at) - size + 1):
            key = tuple(lines[k].strip(d.SPACE) for k in at[i:i + size])
            first = seen.setdefault(key, (doc_id, i))
            begin = max(i, first[1] + size) if first[0] == doc_id else i
            if first != (doc_id, i):
                gone.setdefault(doc_id, set()).update(range(begin, i + size))
    out = []
    for doc_id, text in docs:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        g = {filled[doc_id][i] for i in gone.get(doc_id, ())}
        out.append((doc_id, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in g), len(filled[doc_id]), len(g)))
    return sorted(out, key=str)


def run(spark, docs):
    got = d.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted(((r.doc_id, r.text, r["_lines"], r["_removed"]) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    made = random.Random(5)
    docs = [(i, "\n".join(made.choice(["a", "b", " b ", "c", "", "\t", "dd"]) for _ in range(made.randrange(14)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a\na\na\na\na\na\na"), (None, "n1\nn2\nn3"), (104, "x\nn1\nn2\nn3\ny"),
             (105, "\n".join(f"line {i}" for i in range(5000))), (106, "\n".join(f"line {i}" for i in range(2500, 7500)))]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_are_one_document(spark):
    assert run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")]) == [(1, "a\nb\nc", 3, 0)] * 2


def test_same_id_with_other_text(spark):
    got = run(spark, [(1, "a\nb\nc"), (1, "a\nb\nc\nd")])
    assert sorted(r[3] for r in got) == [0, 3]


def test_stage_drops_what_is_empty_and_keeps_columns(spark):
    docs = spark.sql("select 1L doc_id, 'a\\nb\\nc' text, 3 gone, 4 at union all select 2L, 'a\\nb\\nc', 5, 6 union all select 3L, 'x\\na\\nb\\nc', 7, 8 union all select 4L, null, 1, 1")
    kept = d.drop_repeated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb\nc", 3: "x", 4: None}


def test_empty_table(spark):
    assert run(spark, []) == []
