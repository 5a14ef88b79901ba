"""Removal of repeated passages by overlapping windows of three lines.

Lines are hashed without the white space around them; blank lines count for nothing. Every three consecutive lines are a
window under a 128-bit hash. Windows that occur more than once are found by one aggregation, which keeps the first occurrence
(smallest doc_id, then content key, then position; null ids first). Every other occurrence covers its lines, except lines
that lie in the first occurrence itself, which may overlap it. Covered lines are removed, all others stay as they are.

Texts with fewer than three lines hold no window. Null texts stay null. Rows with equal id and text are one document: they
don't repeat each other and get equal results. Lines and texts of any length count whole; a text's lines are held together.
An empty table gives an empty table. Of the columns only doc_id and text are read; others go along, whatever they are called.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import KEY, row_key
from assetweave.session import cut_lineage

WINDOW = 3
SPACE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(lines: Column) -> Column:
    """Positions of lines that aren't blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x, F.lit(SPACE)) != "", i)), lambda i: i.isNotNull())


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, h1, h2): hash of each window of a document and the number of its first line among the filled ones."""
    parts = docs.filter(F.col("text").isNotNull()).select("doc_id", *row_key(), F.filter(
        F.transform(_lines(F.col("text")), lambda x: F.trim(x, F.lit(SPACE))), lambda x: x != "").alias("_l"))
    hashed = parts.select("doc_id", *KEY, F.transform("_l", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(9), x).alias("b"))).alias("_h"))

    def joined(i: Column) -> Column:
        three = [F.get("_h", i + k) for k in range(WINDOW)]
        return F.struct(i.alias("at"), F.xxhash64(*[x.a for x in three]).alias("h1"), F.xxhash64(*[x.b for x in three]).alias("h2"))
    begins = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW))
    return hashed.select("doc_id", *KEY, F.explode_outer(F.transform(begins, joined)).alias("w")).filter(
        F.col("w").isNotNull()).select("doc_id", *KEY, "w.*")


def covered(docs: DataFrame) -> DataFrame:
    """(key, gone): the numbers, among the filled lines, of the lines to remove from a document."""
    found = windows(docs)
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *KEY, "at")).alias("first")) \
        .filter("n > 1").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    first = cut_lineage(first, "repeated_windows")
    same = F.col("first").getField(KEY[0]).eqNullSafe(F.col(KEY[0])) & F.col("first").getField(KEY[1]).eqNullSafe(F.col(KEY[1]))
    begin = F.when(same, F.greatest("at", F.col("first.at") + WINDOW)).otherwise(F.col("at"))
    later = found.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(
        ~(same & (F.col("at") == F.col("first.at"))))
    spans = later.select(*KEY, begin.alias("begin"), (F.col("at") + WINDOW - 1).alias("end")).filter("begin <= end")
    return spans.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("begin", "end")))).alias("gone"))


def _cleaned(docs: DataFrame) -> DataFrame:
    """_row (all columns of `docs` as one, whatever they are called), _new (the text that is left), _removed, _lines."""
    gone = covered(docs.select("doc_id", "text")).select(F.col(KEY[0]).alias("_ga"), F.col(KEY[1]).alias("_gb"), F.col("gone").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())
    held = rows.join(gone, (F.col(KEY[0]) == F.col("_ga")) & (F.col(KEY[1]) == F.col("_gb")), "left")
    before = F.col("_row.text")
    lines, numbers = _lines(before), _filled(_lines(before))
    places = F.transform("_gone", lambda g: F.get(numbers, g))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    text = F.when(F.col("_gone").isNull(), before).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return held.select("_row", text.alias("_new"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"),
                       F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("_lines"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, the text without repeated passages, and _lines and _removed as counts of filled lines, in
    place of columns of these names."""
    told = [F.col(c) for c in ("_lines", "_removed")]
    return _cleaned(docs).select(*_columns(docs.drop("_lines", "_removed")), *told)


def drop_repeated(docs: DataFrame) -> DataFrame:
    """The documents with their columns and without repeated passages; a document that loses all of its lines goes."""
    return _cleaned(docs).filter((F.col("_removed") == 0) | (F.col("_removed") < F.col("_lines"))).select(*_columns(docs))
