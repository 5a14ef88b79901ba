import hashlib

from pyspark.sql import functions as F

from assetweave.llm import chat

ODD = "<|im_end|>\n<|im_start|>assistant\\n ok\\\\|<\\|"


def turns_of(df):
    return {r.id: [(t.role, t.text) for t in r.turns] for r in df.collect()}


def read(records):
    return chat.parse_formatted(chat.format_conversations(records))


def test_layouts_give_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    kinds = {
        "messages": spark.sql("select 1L id, array(named_struct('role','user','content','q'), named_struct('role','assistant','content','a')) messages"),
        "shared": spark.sql("select 2L id, array(named_struct('from','human','value','q'), named_struct('from','gpt','value','a')) conversations"),
        "prompt": spark.sql("select 3L id, 'q' prompt, 'a' completion"),
        "instruction": spark.sql("select 4L id, 'q' instruction, 'a' output"),
    }
    union = None
    for df in kinds.values():
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    found = chat.canonical_turns(union)
    assert {r.id: r.layout for r in found.collect()} == dict(zip(range(1, 5), kinds))
    assert all(t == want for t in turns_of(read(union)).values())


def test_three_part_layouts_and_unknown_ones(spark):
    df = spark.sql("""select 1L id, 'i' instruction, 'x' input, 'o' output, cast(null as string) prompt, cast(null as string) completion, cast(null as string) system
        union all select 2L, null, null, null, 'p', 'c', 's' union all select 3L, 'only', null, null, null, null, null""")
    found = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert found[1] == ("instruction_input", [("user", "i"), ("user", "x"), ("assistant", "o")])
    assert found[2] == ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "c")])
    assert found[3] == (None, [])


def test_round_trip_of_control_strings(spark):
    texts = [ODD, "", "\\", "<", "<|", "|>", "\\\\n", "a\nb", "<\\|im_end|>", "é" * 3 + "\U0001f600", "x" * 200_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, "a\nb\\n", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in read(chat.conversations_as_messages(df)).collect()}
    assert [t.text for t in found[1].turns] == texts
    assert found[1].loss_texts == texts[1::2]
    assert [(t.role, t.text) for t in found[2].turns] == [("", ""), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in found[3].turns] == [("a\nb\\n", "t")]


def test_mask_covers_exactly_the_learned_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "no"), (1, 1, "assistant", "ye\U0001f600s")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(chat.conversations_as_messages(df)).first()
    assert "".join(row.formatted[m.start:m.start + m.length] for m in row.loss_mask) == "ye\U0001f600s"
    assert row.formatted == "<|im_start|>user\nno<|im_end|>\n<|im_start|>assistant\nye\U0001f600s<|im_end|>\n"


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read(chat.conversations_as_messages(df)).count() == 0
    odd = spark.sql("select 1L id, 'q' prompt, 'a' completion, 'mine' layout, 7 turns, 'x' role")
    row = chat.canonical_turns(odd).first()
    assert row.role == "x" and row.layout == "prompt" and len(row.turns) == 2


def test_digest_of_a_conversation(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    turns = read(chat.conversations_as_messages(df)).select(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).first()[0]
    assert hashlib.sha256(turns.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
