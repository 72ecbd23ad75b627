"""Runs of rows: gap-and-island sessions, consecutive integers, runs of equal values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.intervals import union


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """df with the number (from 1) of each row's island: a new one begins at the first row and where breaks holds.

    breaks may use lag() through previous(); both windows share one shuffle and one sort."""
    w = W.partitionBy(*by).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 1).when(breaks, 1).otherwise(0)
    return df.withColumn("__flag", flag).withColumn(name, F.sum("__flag").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__flag")


def previous(column: str, by: Sequence[str], order: Sequence[str], n: int = 1) -> Column:
    return F.lag(column, n).over(W.partitionBy(*by).orderBy(*order))


def following(column: str, by: Sequence[str], order: Sequence[str], n: int = 1) -> Column:
    return F.lead(column, n).over(W.partitionBy(*by).orderBy(*order))


def integer_runs(df: DataFrame, by: Sequence[str], value: str, width: int = 100_000) -> DataFrame:
    """Distinct consecutive integers as ranges: (by, lo, hi, n); as intervals that are one apart at most."""
    points = df.select(*by, F.col(value).alias("b"), F.col(value).alias("e")).distinct()
    return union(points, by, 1, width).withColumnsRenamed({"b": "lo", "e": "hi"})


def value_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """df with run: rows in a row with an equal value (nulls are equal) have one number."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__value", value)
    return islands(rows, by, order, ~F.lag("__value").over(w).eqNullSafe(F.col("__value")), "run").drop("__value")
