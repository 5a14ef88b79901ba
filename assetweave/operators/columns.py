"""Finding the columns that play a role. Only names are looked at, never rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions.text import strip


def resolve_by_substring(df: DataFrame, role: str) -> str | None:
    """First column whose name contains the role's word, else any of its fallbacks.

    A description column must exist; a missing supplier column gives None.
    """
    word, fallbacks = rules.ROLE_SUBSTRINGS[role]
    for terms in ([word], fallbacks):
        for column in df.columns:
            if any(t in column.lower() for t in terms):
                return column
    if role == "description":
        raise ValueError(f"no description column among {df.columns[:10]}")
    return None


def resolve_by_candidates(df: DataFrame) -> dict[str, str | None]:
    """Column per role by the ordered exact candidate names."""
    present = set(df.columns)
    return {role: next((c for c in rules.ROLE_CANDIDATES[role] if c in present), None)
            for role in ("type", "code", "description", "supplier")}


def _first_filled(df: DataFrame, candidates: list[str]) -> Column:
    present = [c for c in candidates if c in df.columns]
    cleaned = [strip(F.col(f"`{c}`").cast("string")) for c in present]
    filled = [F.when((c != "") & (c != "nan"), c) for c in cleaned]
    return F.coalesce(*filled, F.lit(None).cast("string"))


def coalesce_roles(df: DataFrame, row_key: str) -> DataFrame:
    """Fixed item schema from free-form columns; `row_key` names rows that have no code."""
    def role(name: str) -> Column:
        return _first_filled(df, rules.ROLE_CANDIDATES[name])

    return df.select(
        F.coalesce(role("code"), F.concat(F.lit("ITEM_"), F.col(row_key).cast("string"))).alias("item_code"),
        F.coalesce(role("description"), F.lit("")).alias("description"),
        role("supplier").alias("supplier"),
        F.coalesce(role("category"), F.lit("")).alias("category"),
        F.coalesce(role("type"), F.lit("")).alias("item_type"))


def drop_by_position(df: DataFrame, positions=rules.DROPPED_POSITIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns by position; fails if one that is still needed would go."""
    gone = set(positions)
    lost = [c for i, c in enumerate(df.columns) if i in gone and c in keep]
    if lost:
        raise ValueError(f"columns {lost} are needed but stand at a dropped position")
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in gone])
