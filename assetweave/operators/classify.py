"""Rule classification of items and the curation of labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import text
from assetweave.functions.arrays import explode_computed
from assetweave.functions.text import strip
from assetweave.operators.substring import substring_pairs
from assetweave.session import cut_lineage


def _quoted(term: str) -> str:
    return "'" + term.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cascade(low: str, table, whole_word: bool, otherwise: str) -> Column:
    """First label whose terms occur in the lower-case column `low`, as one SQL CASE."""
    branches = []
    for label, terms in table:
        if whole_word:
            hit = f"rlike({low}, {_quoted(r'(?U)\b(?:' + '|'.join(terms) + r')\b')})"
        else:
            hit = " OR ".join(f"contains({low}, {_quoted(t)})" for t in terms)
        branches.append(f"WHEN {hit} THEN {_quoted(label)}")
    return F.expr(f"CASE {' '.join(branches)} ELSE {otherwise} END")


def classify_vendor(df: DataFrame, vendor: str, out: str = "label", table=rules.VENDOR_RULES) -> DataFrame:
    """Label by vendor name, null when no vendor rule hits."""
    return df.withColumn("_vendor", F.lower(vendor)) \
        .withColumn(out, _cascade("_vendor", table, False, "NULL")).drop("_vendor")


def classify(df: DataFrame, description: str, vendor: str | None = None, out: str = "label",
             signals=rules.SIGNAL_RULES, vendors=rules.VENDOR_RULES,
             whole_word: bool = False) -> DataFrame:
    """Three-way label: empty first, then the vendor rule, then the ordered signals.

    Signals match as raw substrings unless `whole_word` is set. One projection, no Python.
    """
    low = df.withColumn("_low", F.lower(F.col(description)))  # lower-case long texts once
    label = _cascade("_low", signals, whole_word, _quoted(rules.UNKNOWN))
    if vendor:
        low = low.withColumn("_vendor", F.lower(F.col(vendor)))
        label = F.coalesce(_cascade("_vendor", vendors, False, "NULL"), label)
    empty = F.col(description).isNull() | (F.col(description) == "")
    return low.withColumn(out, F.when(empty, rules.UNKNOWN).otherwise(label)).drop("_low", "_vendor")


def classify_by_dictionary(df: DataFrame, key: str, description: str, dictionary: DataFrame,
                           out: str = "label") -> DataFrame:
    """Legacy two-dictionary label: hw term, else sw term, else Non-Instrument.

    dictionary(category, keyword) may be of any size. Distinct words of the descriptions
    meet the dictionary once; a multi-word term is looked up by its longest word and
    verified on the description, so the texts are never compared with every term.
    """
    terms = dictionary.filter(F.col("category").isin("hw", "sw")) \
        .select("category", "keyword", text.lookup_piece(F.col("keyword")).alias("needle"))
    low = df.select(key, F.lower(F.col(description)).alias("_low"))
    hay = explode_computed(low, F.array_distinct(text.pieces(F.col("_low"))), "hay", key)
    pairs = cut_lineage(substring_pairs(terms.select("needle").dropna().distinct(), hay.select("hay").distinct()), "words")
    # single-word terms are decided by the word alone: collapse to one flag per word
    single = terms.filter(F.col("needle") == F.col("keyword")).join(pairs, "needle") \
        .groupBy("hay").agg(F.bool_or(F.col("category") == "hw").alias("hw"),
                            F.bool_or(F.col("category") == "sw").alias("sw"))
    by_word = hay.join(single, "hay").select(key, "hw", "sw")
    longer = terms.filter(F.col("needle") != F.col("keyword")).join(pairs, "needle") \
        .select("hay", "category", "keyword").distinct()
    by_term = hay.join(longer, "hay").select(key, "category", "keyword").distinct().join(low, key) \
        .filter(F.contains("_low", F.col("keyword"))) \
        .select(key, (F.col("category") == "hw").alias("hw"), (F.col("category") == "sw").alias("sw"))
    flags = by_word.unionByName(by_term).groupBy(key).agg(
        F.bool_or("hw").alias("_hw"), F.bool_or("sw").alias("_sw"))
    return (df.join(flags, key, "left").withColumn(out, F.when(F.col("_hw"), "Instrument")
            .when(F.col("_sw"), rules.SOFTWARE).otherwise(rules.NON_INSTRUMENT)).drop("_hw", "_sw"))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("Unlabeled")).alias("label")) \
        .agg(F.count("*").alias("n"))


def compare_labels(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, differences and agreement in percent of two label columns, in one pass."""
    same = F.col(a).eqNullSafe(F.col(b))
    return df.agg(F.count("*").alias("total"), F.count_if(~same).alias("differences"),
                  F.try_divide(100.0 * F.count_if(same), F.count("*")).alias("agreement"))


def relabel(df: DataFrame, corrections: DataFrame, code: str, label: str) -> DataFrame:
    """Apply corrections(code, new_label) to items with a unique code, ignoring case.

    Ambiguous codes, unknown codes and unchanged labels are left alone. Adds `changed`.
    Counting happens before the join, so a code that repeats a billion times is one row.
    """
    keyed = df.withColumn("_key", F.lower(strip(F.col(code).cast("string"))))
    wanted = corrections.select(F.lower(strip(F.col("code").cast("string"))).alias("_key"), "new_label") \
        .groupBy("_key").agg(F.max("new_label").alias("new_label"))
    unique = (keyed.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("n"))
              .filter("n = 1").select("_key"))
    usable = wanted.join(unique, "_key")
    hit = F.col("new_label").isNotNull() & ~strip(F.col(label)).eqNullSafe(F.col("new_label"))
    return (keyed.join(usable, "_key", "left").withColumn("changed", hit)
            .withColumn(label, F.when(hit, F.col("new_label")).otherwise(F.col(label)))
            .drop("_key", "new_label"))


def relabel_by_supplier(df: DataFrame, supplier: str, text: str, label: str, new_label: str,
                        regex: bool = True) -> DataFrame:
    """Give all items of matching suppliers one label; `changed` marks them."""
    low = F.lower(F.col(supplier).cast("string"))
    hit = F.coalesce(low.rlike(text.lower()) if regex else F.contains(low, F.lit(text.lower())), F.lit(False))
    return df.withColumn("changed", hit).withColumn(
        label, F.when(hit, F.lit(new_label)).otherwise(F.col(label)))


def export_subset(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Rows whose trimmed code is in the selection codes(code)."""
    chosen = codes.select(strip(F.col("code").cast("string")).alias("_key")).distinct()
    return df.withColumn("_key", strip(F.col(code).cast("string"))).join(chosen, "_key", "left_semi").drop("_key")
