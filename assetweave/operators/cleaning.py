"""Data quality of supplier names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetweave.functions import names
from assetweave.functions.text import strip


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found among {df.columns}")


def clean(df: DataFrame, column: str) -> DataFrame:
    _require(df, column)
    return df.withColumn(column, names.clean_name(F.col(column)))


def detect_issues(df: DataFrame, column: str) -> DataFrame:
    """Rows with at least one artefact, with the trimmed name and the list of tags."""
    _require(df, column)
    return (df.withColumn("original", strip(F.col(column)))
            .withColumn("issues", names.name_issues(F.col(column)))
            .filter(F.size("issues") > 0))


def _changed(column: str):
    return F.coalesce(strip(F.col(column)) != names.clean_name(F.col(column)), F.lit(False))


def clean_diff(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Before and after of every name that cleaning changes; writes nothing."""
    _require(df, column)
    return df.filter(_changed(column)).select(
        *keys, F.col(column).alias("before"), names.clean_name(F.col(column)).alias("after"))


def clean_status(sources: DataFrame, stats: DataFrame, source: str) -> DataFrame:
    """Per listed source rows_total, rows_cleaned and status: `cleaned`, `unchanged`, or `failed` when no row was read.

    sources(<source>[, error]); an error text that is not null marks a failure as well and is kept.
    """
    known = sources if "error" in sources.columns else sources.withColumn("error", F.lit(None).cast("string"))
    counted = stats.filter(F.col(source).isNotNull())
    status = (F.when(F.col("error").isNotNull() | F.col("rows_total").isNull(), "failed")
              .when(F.col("rows_cleaned") > 0, "cleaned").otherwise("unchanged"))
    return known.join(counted, source, "left").select(
        source, F.coalesce("rows_total", F.lit(0)).alias("rows_total"), F.coalesce("rows_cleaned", F.lit(0)).alias("rows_cleaned"),
        status.alias("status"), "error")


def clean_stats(df: DataFrame, column: str, source: str) -> DataFrame:
    """rows_total and rows_cleaned per source and, with source null, over everything."""
    _require(df, column)
    return (df.withColumn("_hit", _changed(column)).rollup(source)
            .agg(F.count("*").alias("rows_total"), F.count_if("_hit").alias("rows_cleaned")))
