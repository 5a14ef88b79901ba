"""Helpers for computed arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, array: Column, name: str, *keep: Column | str,
                     position: str | None = None) -> DataFrame:
    """A row per element of an array expression, next to the `keep` columns.

    A plain explode lets the optimizer infer `size(array) > 0` and push it down, which
    computes an expensive array twice; the outer form with a filter behind it does not.
    """
    out = (F.posexplode_outer(array).alias(position, name) if position
           else F.explode_outer(array).alias(name))
    return df.select(*keep, out).filter(F.col(name).isNotNull())
