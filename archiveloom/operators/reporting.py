"""The computations behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rescaled(value: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """A value's place between two others on a new scale, which may run the other way; null outside of its range or on an empty one."""
    inside = value.between(F.least(low, high), F.greatest(low, high)) & (low != high)
    return F.when(inside, (value - low) / (high - low) * (to_high - to_low) + to_low)


def increments(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``df`` with ``gain`` over the stage before (the first stage gains its value) and ``gain_share``, the percent of the last value."""
    w = Window.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))
    return df.withColumn("gain", gain).withColumn("gain_share", F.round(F.lit(100.0) * F.col("gain") / F.last(value).over(whole), 1))


def wide(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One row per ``row`` with a column per name; missing cells are null."""
    return df.groupBy(row).pivot(column, names).agg(F.first(value))


def long(df: DataFrame, row: str, names: list[str], column: str = "metric", value: str = "value") -> DataFrame:
    """The reverse of :func:`wide`; missing cells are left out."""
    return df.unpivot(row, names, column, value).where(F.col(value).isNotNull())
