"""Aggregates over matches and the document library."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions.text import preview, ratio_or_zero
from assetweave.operators.filters import age_days

MB = 1024 * 1024


def vendor_overview(vendors: DataFrame, docs: DataFrame, view: str = "all") -> DataFrame:
    """Documents, bytes and latest change per vendor; `view` is all, with_documents or empty."""
    totals = docs.groupBy("supplier").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"),
                                          F.max("modified").alias("last_modified"))
    out = vendors.select("supplier").distinct().join(totals, "supplier", "left").select(
        "supplier", F.coalesce("n", F.lit(0)).alias("documents"), F.coalesce("bytes", F.lit(0)).alias("total_bytes"),
        F.bround(F.coalesce("bytes", F.lit(0)) / MB, 2).alias("total_mb"), "last_modified")
    if view == "all":
        return out
    return out.filter(F.col("documents") > 0 if view == "with_documents" else F.col("documents") == 0)


def match_summary(items: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: items, items with and without a match, matches, average and rate in percent.

    Matches are counted per item before the join, so popular items cost one row.
    """
    per_item = matches.groupBy("item_id").agg(F.count("*").alias("n"))
    joined = items.select("item_id").join(per_item, "item_id", "left")
    total, hit, found = F.count("*"), F.count("n"), F.coalesce(F.sum("n"), F.lit(0))
    return joined.agg(total.alias("items"), hit.alias("with_match"), (total - hit).alias("without_match"),
                      found.alias("matches"), ratio_or_zero(found, total).alias("avg_per_item"),
                      (100 * ratio_or_zero(hit, total)).alias("match_rate"))


def vendor_match_stats(matches: DataFrame) -> DataFrame:
    return matches.groupBy("supplier").agg(
        F.count("*").alias("matches"), F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def _bucket(score: Column) -> Column:
    out = None
    for name, low in rules.SCORE_BUCKETS[:-1]:
        hit = score >= low
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rules.SCORE_BUCKETS[-1][0])


def score_histogram(matches: DataFrame) -> DataFrame:
    """Count per score range; ranges without a match appear with 0."""
    names = [name for name, _ in rules.SCORE_BUCKETS]
    ranges = matches.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    counts = matches.groupBy(_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))
    return ranges.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("matches"))


def score_range(matches: DataFrame) -> DataFrame:
    return matches.agg(*[F.coalesce(f("score"), F.lit(0.0)).alias(name) for name, f in (
        ("average_score", F.avg), ("highest_score", F.max), ("lowest_score", F.min))])


def recommendations(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """The advice whose condition holds, from the one-row summary and score range."""
    facts = summary.select("items", "avg_per_item", "match_rate", F.lit(1).alias("_one")) \
        .join(scores.select("average_score", F.lit(1).alias("_one")), "_one")
    holds = {"low_match_rate": F.col("match_rate") < 50, "low_average_score": F.col("average_score") < 70,
             "few_matches_per_item": (F.col("items") > 100) & (F.col("avg_per_item") < 1)}
    advice = F.array(*[F.when(holds[code], F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
                       for code, message in rules.RECOMMENDATIONS])
    return facts.select(F.explode(F.array_compact(advice)).alias("a")).select("a.code", "a.message")


def supplier_run_stats(suppliers: DataFrame, items: DataFrame, kept: DataFrame, matches: DataFrame) -> DataFrame:
    """Per supplier folder: items kept and skipped and matches found; matches 0 when none."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("supplier").agg(F.count("*").alias(name))
    out = suppliers.select("supplier").distinct()
    for df, name in ((items, "items"), (kept, "kept"), (matches, "matches")):
        out = out.join(count(df, name), "supplier", "left")
    zero = {name: 0 for name in ("items", "kept", "matches")}
    return out.fillna(zero).withColumn("skipped", F.col("items") - F.col("kept"))


def run_totals(per_supplier: DataFrame) -> DataFrame:
    n, hit = F.count("*"), F.count_if(F.col("matches") > 0)
    kept, found = F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("matches"), F.lit(0))
    return per_supplier.agg(
        n.alias("suppliers"), hit.alias("suppliers_with_matches"), kept.alias("items_kept"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("items_skipped"), found.alias("matches"),
        (100 * ratio_or_zero(hit, n)).alias("supplier_match_rate"),
        (100 * ratio_or_zero(found, kept)).alias("item_match_rate"))


def match_detail(items: DataFrame, matches: DataFrame) -> DataFrame:
    """A line per match and a `No matches` line per item without any; sort with sort_matches.

    `matches` carries `text`, or its `text_preview` where whole texts need not move with every match.
    """
    shown = F.col("text_preview") if "text_preview" in matches.columns else detail_preview(F.col("text"))
    joined = items.select("item_id", "description").join(
        matches.select("item_id", F.col("supplier").alias("_s"), "file_name", "score", shown.alias("_shown")), "item_id", "left")
    return joined.select(
        "item_id", "description", F.coalesce("_s", F.lit("No matches")).alias("supplier"),
        F.coalesce("file_name", F.lit("")).alias("file_name"),
        F.coalesce(F.bround("score", 1), F.lit(0.0)).alias("score"),
        F.coalesce("_shown", F.lit("")).alias("text_preview"))


def detail_preview(text: Column) -> Column:
    """What a line of match_detail shows of a document."""
    return preview(text, 200)


def cleanup_preview(docs: DataFrame, now: Column, days: int) -> DataFrame:
    """Number and size of the documents that are at least `days` old."""
    return docs.filter(age_days(F.col("modified"), now) >= days).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def filter_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per supplier: documents before and after the name filter and the share removed."""
    before = docs.groupBy("supplier").agg(F.count("*").alias("before"))
    after = kept.groupBy("supplier").agg(F.count("*").alias("after"), *[
        F.count_if(F.col("category") == c).alias(c) for c in ("high_priority", "medium_priority", "unknown")])
    return before.join(after, "supplier", "left").fillna(0).withColumn(
        "removed_pct", (F.col("before") - F.col("after")) / F.col("before") * 100)


def run_history(runs: DataFrame, k: int = 5, name_chars: int | None = None) -> DataFrame:
    """The k latest runs, newest first, with the duration in whole minutes; `name_chars` shortens file names for display."""
    file = F.col("file") if name_chars is None else F.substring("file", 1, name_chars)
    return (runs.orderBy(F.desc("run")).limit(k)
            .select("run", "time", file.alias("file"), F.coalesce(F.concat(F.floor(F.col("seconds") / 60), F.lit("m")), F.lit("-")).alias("duration"),
                    "status"))


def progress(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items in total, already in the results, still open, and percent done."""
    total = items.agg(F.count("*").alias("total"), F.lit(1).alias("_one"))
    done = results.agg(F.count_distinct("item_id").alias("processed"), F.lit(1).alias("_one"))
    return total.join(done, "_one").select(
        "total", "processed", (F.col("total") - F.col("processed")).alias("remaining"),
        (100 * ratio_or_zero(F.col("processed"), F.col("total"))).alias("progress"))


def remaining_items(items: DataFrame, results: DataFrame) -> DataFrame:
    return items.join(results.select("item_id").distinct(), "item_id", "left_anti")


def resume_from(items: DataFrame, position: str, start: int) -> DataFrame:
    return items.filter(F.col(position) >= start)


def orphan_docs(library: DataFrame, referenced: DataFrame) -> DataFrame:
    """Library files that no result refers to; listed, never deleted."""
    return library.join(referenced.select("file_name").distinct(), "file_name", "left_anti")


def items_by_supplier(items: DataFrame, folders: DataFrame, columns: list[str]) -> DataFrame:
    """Items per supplier folder: the first of the supplier columns that has any hit counts.

    For every folder the candidate columns are tried in order. Which column wins is decided
    on counts, so no folder's items are gathered in one place.
    """
    from assetweave.functions.text import strip
    present = [c for c in columns if c in items.columns]
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), F.lower(strip(F.col(f"`{c}`").cast("string"))).alias("_key"))
                     for i, c in enumerate(present)])
    names = folders.select(F.col("supplier").alias("folder"), F.lower(strip(F.col("supplier"))).alias("_key")).distinct()
    long = items.withColumn("_k", F.explode(keys)).select("*", "_k.rank", "_k._key").drop("_k")
    winner = (long.groupBy("_key").agg(F.min("rank").alias("rank")).join(names, "_key"))
    return long.join(winner, ["_key", "rank"]).drop("_key", "rank")
