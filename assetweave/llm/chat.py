"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in several layouts: a list of messages, question and answer columns, an instruction with input and
output, or a question with its history. A record's fingerprint is the hash of the nested field paths that it fills.
The fingerprint selects a declarative mapping, and the mapping says where roles and texts lie.

Template: `<|im_start|>` role, line break, text, `<|im_end|>`, line break. Inside roles and texts a backslash is
doubled and the bar after `<` gets a backslash in front, so that no control string can occur there; line breaks of
a role become `\\n`. `unescape` undoes this exactly.

Null texts and roles are empty. Turns are ordered by turn, then role and text, nulls first. A record whose paths fit no
mapping gives no turns and is reported with a null layout.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetweave.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """`required` paths select the layout. `turns` are (role, path of the text) in order, or `items` names a list and
    the fields of its role and text."""

    name: str
    required: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("shared", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"),
           roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", ("completion", "prompt", "system"),
           turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"),
           turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def _paths(kind: T.StructType, prefix: str = "") -> list[tuple[str, list[str]]]:
    """(path, steps) of every leaf; a step `[]` goes into the elements of a list."""
    out = []
    for f in kind.fields:
        at, inner, steps = f"{prefix}{f.name}", f.dataType, [f.name]
        while isinstance(inner, T.ArrayType):
            at, inner, steps = at + "[]", inner.elementType, [*steps, "[]"]
        if isinstance(inner, T.StructType):
            out += [(f"{at}.{p}", [*steps, *s]) for p, s in _paths(inner)]
        else:
            out.append((at, steps))
    return out


def _filled(value: Column, steps: list[str]) -> Column:
    """Whether anything but null lies at the end of the steps."""
    if not steps:
        return value.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(value, lambda x: F.coalesce(_filled(x, steps[1:]), F.lit(False))), F.lit(False))
    return _filled(value.getField(steps[0]), steps[1:])


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the sorted paths that a record fills, of those that any layout asks for. Other columns don't count."""
    known = {p for x in layouts for p in x.required}
    found = sorted((p, s) for p, s in _paths(df.schema) if p in known)
    names = [F.when(_filled(F.col(f"`{s[0]}`"), s[1:]), F.lit(p)) for p, s in found]
    return F.xxhash64(F.concat_ws("\n", *names)) if names else F.xxhash64(F.lit(""))


def _hash_of(layout: Layout) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(layout.required))))


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """All columns but those of layouts, `layout` and `turns` as a list of (role, text)."""
    have = {p for p, _ in _paths(df.schema)}
    usable = [x for x in layouts if set(x.required) <= have]
    mark, layout, turns = fingerprint(df, layouts), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in usable:
        chosen = F.col("_fingerprint") == _hash_of(x)
        layout = F.when(chosen, F.lit(x.name)).otherwise(layout)
        turns = F.when(chosen, _mapped(x).cast(TURNS)).otherwise(turns)
    used = {p.split("[")[0].split(".")[0] for x in layouts for p in x.required}
    return df.withColumn("_fingerprint", mark).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in used | {"layout", "turns"}],
        layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _mapped(x: Layout) -> Column:
    if x.items is None:
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(p), F.lit("")).alias("text"))
                         for r, p in x.turns])
    items, role, text = x.items

    def one(m: Column) -> Column:
        name = F.coalesce(m.getField(role), F.lit(""))
        for old, new in x.roles:
            name = F.when(name == old, F.lit(new)).otherwise(name)
        return F.struct(name.alias("role"), F.coalesce(m.getField(text), F.lit("")).alias("text"))
    return F.transform(F.col(items), one)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Doubled backslashes are found from the left; a single one then stands before a bar or an n."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda p: F.replace(
        F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_mask`, the (start, length) in code points of each text to learn, in order."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), _escape_role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body"),
        (t.role == learn).alias("learn")))
    df = df.withColumn("_parts", parts)
    sizes = F.transform("_parts", lambda p: F.struct(
        F.length(p.head).cast("long").alias("head"), F.length(p.body).cast("long").alias("body"), p.learn.alias("learn")))
    tail = len(END) + 1
    # one pass over the turns: where the text so far ends, and the spans to learn
    spans = F.aggregate(
        sizes, F.struct(F.lit(0).cast("long").alias("at"),
                        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, s: F.struct(
            (a.at + s["head"] + s.body + F.lit(tail)).alias("at"),
            F.when(s.learn, F.concat(a.spans, F.array(F.struct((a.at + s["head"]).alias("start"), s.body.alias("length")))))
            .otherwise(a.spans).alias("spans")), lambda a: a.spans)
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p.body, F.lit(END + "\n"))), "")
    return df.withColumns({"formatted": text, "loss_mask": spans}).drop("_parts")


def parse_formatted(df: DataFrame) -> DataFrame:
    """`turns` and `loss_texts` of formatted records, from `formatted` and `loss_mask` alone."""
    pieces = F.slice(F.split(F.col("formatted"), r"<\|im_start\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        body = F.substring(p, 1, F.length(p) - len(END) - 1)
        cut = F.locate("\n", body)
        return F.struct(unescape(F.substring(body, 1, cut - 1)).alias("role"),
                        unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))
    lost = F.transform("loss_mask", lambda m: unescape(
        F.substring(F.col("formatted"), (m.start + 1).cast("int"), m.length.cast("int"))))
    return df.withColumns({"turns": F.transform(pieces, turn), "loss_texts": lost})


def conversations_as_messages(rows: DataFrame) -> DataFrame:
    """One record per conversation in the messages layout. A conversation is one output text, so its turns meet."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                   F.coalesce("text", F.lit("")).alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
                                       .alias("messages"))


def format_conversations(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(…, layout, formatted, loss_mask), written to the shared folder and read back."""
    return cut_lineage(format_turns(canonical_turns(records, layouts)).drop("turns"), "chat")
