"""Running values over long keys in two levels: within buckets of the ordering column, and over the buckets.

A window by key alone puts a key into one task.  Here a task holds one bucket of one key, and only the
buckets' totals, a row each, go through a window by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How each running value is taken over rows or over totals, and how a bucket's own is joined with what came before it.
_TAKEN = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def _with_earlier(kind: str, own: Column, earlier: Column) -> Column:
    if kind == "sum":
        return F.when(own.isNotNull() | earlier.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(earlier, F.lit(0)))
    return F.greatest(own, earlier) if kind == "max" else F.coalesce(own, earlier)


def running(df: DataFrame, by: Sequence[str], at: str, width: int, value: Column, kind: str, name: str, ties: Sequence[str] = (), itself: bool = False) -> DataFrame:
    """df with name: the max, sum or last non-null of value over the key's rows before each row in order of at and ties (itself: and of the row); null if there is none.

    width: how much of at makes a bucket."""
    rows = df.withColumn("__value", value).withColumn("__bucket", F.floor(F.col(at) / width))
    inside = W.partitionBy(*by, "__bucket").orderBy(at, *ties)
    rows = rows.withColumn("__own", _TAKEN[kind]("__value").over(inside.rowsBetween(W.unboundedPreceding, 0 if itself else -1)))
    total = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(at, *ties))) if kind == "last" else _TAKEN[kind]("__value")
    totals = df.withColumn("__value", value).groupBy(*by, F.floor(F.col(at) / width).alias("__bucket")).agg(total.alias("__total"))
    over = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "__bucket", _TAKEN[kind]("__total").over(over).alias("__earlier"))
    return rows.join(totals, [*by, "__bucket"]).withColumn(name, _with_earlier(kind, F.col("__own"), F.col("__earlier"))).drop("__value", "__bucket", "__own", "__earlier")


def at_ranks(df: DataFrame, by: Sequence[str], value: str, width: int, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics without collecting a key's values: (by, one column for each rank: the value at that place of the sorted ones, from 0; ranks may use n, the key's number of values).

    Equal values are counted before they shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    rows = running(counts, by, value, width, F.col("__n"), "sum", "__before").withColumn("__before", F.coalesce("__before", F.lit(0)))
    size = counts.groupBy(*by).agg(F.sum("__n").alias("n"))
    rows = rows.join(size, list(by)) if by else rows.crossJoin(F.broadcast(size))  # one row
    found = [F.max(F.when((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return rows.groupBy(*by).agg(*found)


def middle(df: DataFrame, by: Sequence[str], value: str, width: int, name: str = "median") -> DataFrame:
    """Exact medians: the mean of the middle two."""
    both = at_ranks(df, by, value, width, {"__low": F.floor((F.col("n") - 1) / 2), "__high": F.floor(F.col("n") / 2)})
    return both.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias(name))
