"""Ranking, top-k and deduplication."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import names, text
from assetweave.session import cut_lineage


def prioritize(docs: DataFrame, caps: dict[str, int] = rules.PRIORITY_CAPS) -> DataFrame:
    """Per supplier the documents worth reading: a few of each name category.

    Rank on names only and join the texts afterwards. The constant row limit lets Spark
    cut every (supplier, category) group inside the map tasks, so a supplier that owns a
    third of the library never reaches one task whole.
    """
    limit = F.lit(0)
    for category, cap in caps.items():
        limit = F.when(F.col("category") == category, cap).otherwise(limit)
    window = Window.partitionBy("supplier", "category").orderBy("file_name", "doc_id")
    return (docs.withColumn("category", names.doc_category(F.col("file_name")))
            .withColumn("priority", names.doc_priority(F.col("file_name")))
            .withColumn("place", F.row_number().over(window))
            .filter(F.col("place") <= max(caps.values())).filter(F.col("place") <= limit))


def dedup_matches(matches: DataFrame, per: str | list[str] = "item_id") -> DataFrame:
    """Best match per item and folded file name, ties to the first path."""
    per = [per] if isinstance(per, str) else per
    rest = [c for c in matches.columns if c not in per]
    best = F.min(F.struct((-F.col("score")).alias("_s"), "file_name", *[c for c in rest if c != "file_name"]))
    return (matches.groupBy(*per, names.normalize_file_name(F.col("file_name")).alias("file_key"))
            .agg(best.alias("b")).select(*per, "file_key", *[F.col(f"b.{c}").alias(c) for c in rest]))


def text_budget(parts: DataFrame, key: str, position: str, column: str = "text", *,
                max_parts: int, max_chars: int) -> DataFrame:
    """Text of a document put together from its leading parts.

    Parts are numbered from 0, each number once per key; of several rows the first text is
    taken. Empty ones are skipped; the part that exceeds `max_chars` is still taken and ends
    the text. Only `max_parts` rows per key are ever shuffled.
    """
    kept = parts.filter((F.col(position) < max_parts) & (F.length(column) > 0)) \
        .groupBy(key, position).agg(F.min(column).alias(column))
    ordered = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(position).alias("p"), F.col(column).alias("t")))).alias("ps"))
    joined = F.aggregate("ps", F.lit(""), lambda acc, p: F.when(
        F.length(acc) > max_chars, acc).otherwise(F.concat(acc, p["t"], F.lit(" "))))
    return ordered.select(key, text.strip(joined).alias("text"))


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add `number` (from 1, in the given order) and `total` without a one-task window.

    Rows are written before the sort, which reads them twice, then range-sorted and materialised; each partition then only needs the number of
    rows before it, a table with one row per partition.
    """
    low_bits = (1 << 33) - 1
    placed = cut_lineage(cut_lineage(df).orderBy(*order).withColumn("_part", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(low_bits)))
    # one row per partition, so these two windows stay tiny whatever the data size
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("n").over(everything).alias("total"))
    return (placed.join(offsets, "_part").withColumn("number", F.col("_before") + F.col("_pos") + 1)
            .drop("_part", "_pos", "_before"))


def number_matches(matches: DataFrame, *order: Column | str) -> DataFrame:
    """`PDF i/total: name (Score: s%)` per match."""
    return number_rows(matches, *order).withColumn("result", F.concat(
        F.lit("PDF "), F.col("number"), F.lit("/"), F.col("total"), F.lit(": "), F.col("file_name"),
        F.lit(" (Score: "), F.call_function("format_number", "score", F.lit("0.0")), F.lit("%)")))


def sort_matches(matches: DataFrame, *ties: str) -> DataFrame:
    return matches.orderBy(F.desc("score"), *ties)


def list_items(df: DataFrame, label: str, n: int, type_column: str, *order: str) -> DataFrame:
    from assetweave.operators.filters import of_type
    return of_type(df, type_column, label).orderBy(*order).limit(n)


def first_per_domain(hits: DataFrame, domain: Column, per: str = "supplier", order: str = "pos") -> DataFrame:
    """First URL of each domain, pre-aggregated."""
    return (hits.withColumn("domain", domain).filter(F.col("domain") != "")
            .groupBy(per, "domain").agg(F.min(F.struct(order, "url")).alias("f"))
            .select(per, "domain", F.col(f"f.{order}").alias(order), F.col("f.url").alias("url")))
