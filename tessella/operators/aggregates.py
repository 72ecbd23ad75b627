"""Aggregates that the domain defines its own way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.prefix import at_ranks


def ordered_mode(df: DataFrame, by: Sequence[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """The commonest non-null value of each group; ties go to the value seen first by order.  Counts combine before they shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(*by).agg(F.max(F.struct("__n", (-F.col("__first")).alias("__early"), value)).alias("__x")).select(*by, F.col(f"__x.{value}").alias(name), F.col("__x.__n").alias("n"))


def lower_percentiles(df: DataFrame, by: Sequence[str], column: str, shares: dict[str, float], width: int) -> DataFrame:
    """(by, a column for each share: the element at floor(share * (n - 1)) of the sorted values, never an interpolated one)."""
    return at_ranks(df, by, column, width, {name: F.floor(F.lit(share) * (F.col("n") - 1)) for name, share in shares.items()})


def shares(df: DataFrame, by: Sequence[str], kind: str, weight: Column) -> DataFrame:
    """Each kind's percent of its group's weight: (by, kind, weight, share)."""
    sums = df.groupBy(*by, kind).agg(F.sum(weight).alias("weight"))
    whole = F.sum("weight").over(W.partitionBy(*by)) if by else F.sum("weight").over(W.partitionBy())
    return sums.withColumn("share", F.col("weight") * 100 / whole)


def median_with_zeros(counts: DataFrame, column: str, value: str, n: DataFrame) -> DataFrame:
    """Each column's median over all rows there are (n: one row, n), 0 where counts has none: (column, median, rows, used).

    The zeros are only counted, so no row is made for them."""
    by_value = counts.groupBy(column, value).agg(F.count("*").alias("__times")).crossJoin(F.broadcast(n))  # one row
    own = W.partitionBy(column)
    rows = by_value.withColumn("__used", F.sum("__times").over(own)).withColumn("__upto", F.sum("__times").over(own.orderBy(value)) + F.col("n") - F.col("__used"))

    def at(rank: Column) -> Column:
        return F.coalesce(F.min(F.when(F.col("__upto") > rank, F.col(value))), F.lit(0))

    zeros = F.first("n") - F.first("__used")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = [F.when(F.floor((F.first("n") - 1) / 2) < zeros, 0).otherwise(at(low)), F.when(F.floor(F.first("n") / 2) < zeros, 0).otherwise(at(high))]
    return rows.groupBy(column).agg(((found[0] + found[1]) / 2).alias("median"), F.first("n").alias("rows"), F.first("__used").alias("used"))


def weighted_mix(df: DataFrame, by: Sequence[str], path: str, value: str, weight: str) -> DataFrame:
    """Weighted mean of each path's non-null values: (by, path, mix)."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    return rows.groupBy(*by, path).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mix"))


def layered(df: DataFrame, by: Sequence[str], path: str, rank: str, value: str) -> DataFrame:
    """Layered settings: of each path the non-null value of the highest rank: (by, path, value, rank)."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*by, path).agg(F.max(F.struct(rank, value)).alias("__x")).select(*by, path, F.col(f"__x.{value}").alias(value), F.col(f"__x.{rank}").alias(rank))


def grid_heat(df: DataFrame, by: Sequence[str], cell: int, weight: str) -> DataFrame:
    """How long each grid cell is covered by boxes (x0, y0, x1, y1), as percent of the group's most: (by, x, y, heat)."""
    x = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell)))
    y = F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor((F.col("y1") - 1) / cell)))
    cells = df.select(*by, weight, "y0", "y1", x.alias("x")).select(*by, weight, "x", y.alias("y"))
    sums = cells.groupBy(*by, "x", "y").agg(F.sum(weight).alias("__sum"))
    return sums.select(*by, "x", "y", (F.col("__sum") * 100 / F.max("__sum").over(W.partitionBy(*by))).alias("heat"))
