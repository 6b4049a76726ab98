"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list[str | Column], array: str | Column, at: str, value: str) -> DataFrame:
    """One row per element with its 0-based place.

    The outer form is used because the plain one makes the optimiser test the
    array once more below the projection, which repeats a costly expression.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias(at, value))
    return out.where(F.col(at).isNotNull())
