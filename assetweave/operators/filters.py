"""Row filters. Each is a predicate that Catalyst can push towards the scan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions import urls
from assetweave.functions.text import contains_any, strip


def _norm(c: str) -> Column:
    return F.lower(strip(F.col(c)))


def exclude_types(df: DataFrame, column: str, labels=("non-instrument", "software")) -> DataFrame:
    """Rows whose label is none of `labels`; unlabelled rows stay."""
    return df.filter(~F.coalesce(_norm(column), F.lit("")).isin(*labels))


def include_types(df: DataFrame, column: str, labels=("instrument", "research instrument")) -> DataFrame:
    return df.filter(_norm(column).isin(*labels))


def of_type(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows of one label, compared without case; `unlabeled` means null or blank."""
    if label.lower() == "unlabeled":
        return df.filter(F.col(column).isNull() | (strip(F.col(column)) == ""))
    return df.filter(_norm(column) == label.lower())


def search(df: DataFrame, term: str, columns: list[str], type_column: str | None = None,
           label: str | None = None, regex: bool = True) -> DataFrame:
    """Rows in which the term occurs in any of the columns, optionally of one label."""
    term, hit = term.lower(), F.lit(False)
    for column in columns:
        low = F.lower(F.col(column).cast("string"))
        hit = hit | F.coalesce(low.rlike(term) if regex else F.contains(low, F.lit(term)), F.lit(False))
    out = df.filter(hit)
    return of_type(out, type_column, label) if type_column and label else out


def doc_gate(df: DataFrame, min_text: int = rules.MIN_TEXT_CHARS,
             max_bytes: int = rules.MAX_DOCUMENT_BYTES) -> DataFrame:
    """Documents worth scoring: sane size, PDF header when known, enough text, no odd names.

    docs(file_name, size_bytes, text[, head]); `head` holds the first characters.
    """
    ok = ((F.col("size_bytes") > 0) & (F.col("size_bytes") <= max_bytes)
          & ~contains_any(F.lower("file_name"), rules.SKIPPED_NAME_PARTS)
          & (F.length(strip(F.col("text"))) >= min_text))
    if "head" in df.columns:
        ok = ok & F.startswith("head", F.lit("%PDF"))
    return df.filter(ok)


def download_gate(found: DataFrame, have: DataFrame, check_type: bool = False,
                  min_bytes: int = rules.MIN_DOWNLOAD_BYTES, max_bytes: int = rules.MAX_DOWNLOAD_BYTES) -> DataFrame:
    """Downloads to keep: size within limits and file not there yet.

    found(supplier, url, size_bytes[, content_type]); have(supplier, file_name).
    """
    ok = F.col("size_bytes").between(min_bytes, max_bytes) \
        & urls.valid_url(F.col("url"))
    if check_type:
        ok = ok & (F.contains(F.lower("content_type"), F.lit("pdf")) | urls.is_document(F.col("url")))
    return (found.filter(ok).withColumn("file_name", urls.safe_file_name(F.col("url")))
            .join(have.select("supplier", "file_name").distinct(), ["supplier", "file_name"], "left_anti"))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000)).cast("long")


def due_for_rescan(sites: DataFrame, state: DataFrame, now: Column,
                   days: int = rules.RESCAN_DAYS) -> DataFrame:
    """Sites never seen, seen at least `days` ago, or with an unreadable time.

    sites(supplier, ...); state(supplier, last_seen string) with one row per supplier.
    """
    last = F.try_to_timestamp(F.col("last_seen"))
    due = F.col("last_seen").isNull() | last.isNull() | (age_days(last, now) >= days)
    return sites.join(state, "supplier", "left").filter(due).drop("last_seen")


def older_than(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    return df.withColumn("age_days", age_days(F.col(column), now)).filter(F.col("age_days") >= days)


def at_least(df: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    return df.filter(F.col(column) >= threshold)


def sample_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in an explicit order (the trial mode of a run)."""
    return df.orderBy(*order).limit(n)
