"""Interval algebra: union, complement, difference, overlap, and range joins that Spark can shuffle by key.

An interval is [b, e) in integers.  Joins on a range place each interval into the fixed-width buckets
that it touches, so they are equi-joins on (key, bucket) instead of nested loops; a pair that meets in
several buckets is kept in the first bucket that both touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.prefix import running

#: A day in microseconds: what of a key one task takes, unless the caller knows better.
WIDTH = 86_400_000_000


def _after(df: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """(by, b, e, before): before is the latest end of the key's earlier intervals."""
    return running(df.select(*by, "b", "e"), by, "b", width, F.col("e"), "max", "before", ("e",))


def with_period(df: DataFrame, by: Sequence[str], tolerance: int = 0, width: int = WIDTH) -> DataFrame:
    """df with period: where the busy period begins that the interval is in; periods are more than tolerance apart."""
    rows = running(df, by, "b", width, F.col("e"), "max", "__before", ("e",))
    start = F.when(F.col("__before").isNull() | (F.col("b") > F.col("__before") + tolerance), F.col("b"))
    return running(rows, by, "b", width, start, "last", "period", ("e",), itself=True).drop("__before")


def union(df: DataFrame, by: Sequence[str], tolerance: int = 0, width: int = WIDTH) -> DataFrame:
    """Merged intervals (by, b, e, n): those that overlap, touch or are at most tolerance apart are one."""
    rows = with_period(df.select(*by, "b", "e"), by, tolerance, width)
    return rows.groupBy(*by, "period").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.count("*").alias("n")).drop("period")


def complement(df: DataFrame, by: Sequence[str], least: int = 1, width: int = WIDTH) -> DataFrame:
    """Gaps between the first and the last interval of each key: (by, b, e)."""
    rows = _after(df, by, width).select(*by, F.col("before").alias("__b"), F.col("b").alias("__e"))
    return rows.where(F.col("__e") - F.col("__b") >= least).select(*by, F.col("__b").alias("b"), F.col("__e").alias("e"))


def _bucketed(df: DataFrame, b: Column, e: Column, width: int, name: str) -> DataFrame:
    first, last = F.floor(b / width), F.floor(F.greatest(e, b) / width)
    return df.withColumn(f"__first_{name}", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, touching: bool = False) -> DataFrame:
    """All pairs with equal keys whose intervals overlap (touching: or share an end); right's other columns and its rb, re are appended.

    width: the buckets' width, about the length of a typical interval.  Each pair comes once."""
    right = right.withColumnRenamed("b", "rb").withColumnRenamed("e", "re")
    left = _bucketed(left, F.col("b"), F.col("e"), width, "l")
    right = _bucketed(right, F.col("rb"), F.col("re"), width, "r")
    meets = (F.col("b") <= F.col("re")) & (F.col("rb") <= F.col("e")) if touching else (F.col("b") < F.col("re")) & (F.col("rb") < F.col("e"))
    joined = left.join(right, [*on, "__bucket"]).where(meets & (F.col("__bucket") == F.greatest("__first_l", "__first_r")))
    return joined.drop("__bucket", "__first_l", "__first_r")


def difference(df: DataFrame, cuts: DataFrame, by: Sequence[str], key: Sequence[str], width: int) -> DataFrame:
    """What of each interval (key names it within by) no cut covers: (by, key, b, e)."""
    inside = overlap_join(df.select(*by, *key, "b", "e"), union(cuts, by).drop("n"), by, width)
    w = W.partitionBy(*by, *key).orderBy("rb")
    pieces = inside.select(*by, *key, F.coalesce(F.lag("re").over(w), F.col("b")).alias("pb"), F.col("rb").alias("pe"), "e", "re", F.row_number().over(W.partitionBy(*by, *key).orderBy(F.desc("rb"))).alias("__last"))
    before = pieces.select(*by, *key, F.col("pb").alias("b"), F.col("pe").alias("e"))
    after = pieces.where("__last = 1").select(*by, *key, F.col("re").alias("b"), F.col("e"))
    whole = df.select(*by, *key, "b", "e").join(inside.select(*by, *key).distinct(), [*by, *key], "left_anti")
    return before.unionByName(after).unionByName(whole).where("b < e")


def overlap_sum(df: DataFrame, others: DataFrame, by: Sequence[str], key: Sequence[str], width: int) -> DataFrame:
    """How much of each interval the others cover, overlapping ones counted each: (by, key, covered)."""
    found = overlap_join(df.select(*by, *key, "b", "e"), others.select(*by, "b", "e"), by, width)
    sums = found.groupBy(*by, *key).agg(F.sum(F.least("e", "re") - F.greatest("b", "rb")).alias("covered"))
    return df.select(*by, *key).join(sums, [*by, *key], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
