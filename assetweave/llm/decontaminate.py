"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is `size` consecutive words of an item, or all words of a shorter item. Its set elements are shingles of two
neighbouring words. Containment asks for every shingle of a window, so the prefix that a text must share is one shingle:
the rarest one, by word counts over the whole corpus. Texts are searched for these shingles only. A find then has to
leave room for the window on its left (positional bound) and on its right (length bound), and the words around it must
equal the window.

Words are runs of ASCII digits and letters and of all characters beyond ASCII, with A-Z in lower case. Null texts have
no words. An item with a null id marks words but is not counted or listed. Rows with equal id and text are separate
rows with equal results; benchmark rows that repeat count once per item id. Shingles that are equally rare go by their place.
Texts of any length are searched whole. An empty benchmark hits nothing, an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.functions.arrays import explode_computed
from assetweave.llm.common import KEY, row_key
from assetweave.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
LITERAL_LIMIT = 20_000  # words held inside an expression; beyond it the search goes in blocks


def _pieces(low: Column) -> Column:
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def words(text: Column) -> Column:
    return _pieces(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def item_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window) for every window of every item."""
    items = cut_lineage(benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0"), "items")
    return explode_computed(items, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda s: F.slice("w", s + 1, size)),
        "window", "item_id").distinct()


def _word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often the words of the benchmark occur in the corpus. It only ranks shingles, so full lower case will do."""
    low = _pieces(F.lower("text"))
    few = [r[0] for r in vocabulary.limit(LITERAL_LIMIT + 1).collect()]
    if len(few) <= LITERAL_LIMIT:
        low = F.filter(low, lambda w: w.isin(few))
    found = explode_computed(docs.filter(F.col("text").isNotNull()), low, "word").groupBy("word").count()
    return found if len(few) <= LITERAL_LIMIT else found.join(vocabulary, "word", "left_semi")


def anchored_windows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window, at, anchor): each window with its rarest shingle and where in the window that begins."""
    windows = cut_lineage(item_windows(benchmark, size), "windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = cut_lineage(_word_counts(docs, cut_lineage(vocabulary, "vocabulary")), "word_counts")
    placed = windows.select("item_id", "window", F.posexplode("window").alias("at", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("item_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("count", F.lit(0)).cast("double").alias("n")))).alias("c"))
    # a pair is expected as often as the product of its words' counts; the first of the rarest is taken
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(
        (F.get("c", i).n * F.get("c", i + 1).n).alias("n"), i.alias("at")))
    at = F.when(F.size("c") > 1, F.array_min(pairs)["at"]).otherwise(0)
    return ranked.select("item_id", "window", at.alias("at")).withColumn("anchor", F.concat_ws(
        " ", F.get("window", F.col("at")), F.get("window", F.col("at") + 1)))


def _blocks(anchors: DataFrame) -> list[list[str]]:
    """Distinct anchors in blocks. Their number depends on the benchmark, not on the corpus."""
    block, out = [], []
    for r in anchors.select("anchor").distinct().orderBy("anchor").toLocalIterator():
        block.append(r[0])
        if len(block) == LITERAL_LIMIT:
            out.append(block)
            block = []
    return [*out, block] if block or not out else out


def _finds(anchors: list[str], size: int) -> Column:
    """Where an anchor begins, with the words that a window around it can reach."""
    split = [a.split(" ") for a in anchors]
    single = sorted({a[0] for a in split if len(a) == 1})
    first, second = sorted({a[0] for a in split if len(a) == 2}), sorted({a[1] for a in split if len(a) == 2})
    whole = [a for a, s in zip(anchors, split, strict=True) if len(s) == 2]

    def is_anchor(w: Column, i: Column) -> Column:
        after = F.get("w", i + 1)
        return (w.isin(single) | (w.isin(first) & after.isin(second) & F.concat_ws(" ", w, after).isin(whole)))
    begins = F.filter(F.transform("w", lambda w, i: F.when(is_anchor(w, i), i)), lambda i: i.isNotNull())

    def context(i: Column) -> Column:
        left = F.greatest(i - (size - 2), F.lit(0))
        # after a single-word anchor only the word itself may be compared, so both forms are offered
        return F.struct(i.alias("p"), left.alias("left"), F.slice("w", left + 1, i - left + size).alias("near"))
    return F.transform(begins, context)


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): a row per document with its key and number of words; (row, start, length, item_id) per occurrence.

    `rows` carries `row`, doc_id, the content key and n_words, and is a written table, so that `row` stays what it is.
    """
    anchors = cut_lineage(anchored_windows(docs, benchmark, size), "anchors")
    base = docs.select("doc_id", *row_key(), words(F.col("text")).alias("w"))
    finds = [_finds(block, size) for block in _blocks(anchors)]
    rows = cut_lineage(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KEY,
                                   F.size("w").cast("long").alias("n_words"), F.concat(*finds).alias("finds")), "finds")
    found = rows.filter(F.size("finds") > 0).select("row", "n_words", F.explode("finds").alias("f")).select(
        "row", "n_words", "f.*")
    here = F.get("near", F.col("p") - F.col("left"))
    after = F.get("near", F.col("p") - F.col("left") + 1)
    # the two anchors that can begin at a place: the word and the pair
    tried = found.withColumn("anchor", F.explode(F.array_distinct(F.array(here, F.concat_ws(" ", here, after)))))
    start, length = F.col("p") - F.col("at"), F.size("window")
    near = F.slice("near", F.greatest(start - F.col("left") + 1, F.lit(1)), length)
    hits = tried.join(anchors, "anchor").filter(
        (start >= 0) & (start + length <= F.col("n_words")) & (near == F.col("window"))).select(
        "row", start.alias("start"), length.alias("length"), "item_id").distinct()
    return rows.drop("finds"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """A row per document: doc_id, its key, n_words, n_hit, items (sorted ids as strings), contaminated."""
    rows, hits = find_windows(docs, benchmark, size)
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.length - 1))))
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans"),
                                      F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_row = per_row.select("row", F.size(places).cast("long").alias("n_hit"), "items")
    return rows.join(per_row, "row", "left").select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The documents without any window of the benchmark, with their columns, whatever these are called."""
    bad = decontaminate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), size).filter("contaminated").select(
        F.col(KEY[0]).alias("_bad_a"), F.col(KEY[1]).alias("_bad_b")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())
    return rows.join(bad, (F.col(KEY[0]) == F.col("_bad_a")) & (F.col(KEY[1]) == F.col("_bad_b")), "left_anti").select("_row.*")
