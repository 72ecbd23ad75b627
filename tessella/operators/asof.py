"""As-of joins by one union and one window per direction: no range join, one shuffle by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, tie: str, direction: str = "backward", strict: bool = False) -> DataFrame:
    """left with found: the struct of right's columns at the last place at or before left's (forward: the first at or after; nearest: the nearer of the two, the earlier on ties).

    strict: equal places don't count.  tie: right's column that decides among equal places; the last (forward: first) one wins."""
    columns = [c for c in right.columns if c not in by]
    kind = right.select(F.struct(*columns).alias("r")).schema["r"].dataType
    rows = left.select(*by, F.col(left_on).alias("__at"), F.lit(None).cast(kind).alias("__right"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    left_kind = rows.schema["__left"].dataType
    rows = rows.unionByName(right.select(*by, F.col(right_on).alias("__at"), F.struct(*columns).alias("__right"), F.lit(None).cast(left_kind).alias("__left")))
    side = F.col("__left").isNotNull()
    order = (F.col("__at"), F.when(side, 0 if strict else 1).otherwise(1 if strict else 0), F.col(f"__right.{tie}"))
    back = F.last("__right", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    order = (F.desc("__at"), F.desc(F.when(side, 1 if strict else 0).otherwise(0 if strict else 1)), F.desc(f"__right.{tie}"))
    ahead = F.last("__right", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # backwards, as a frame to the end is gone through anew for each row
    if direction == "backward":
        found: Column = back
    elif direction == "forward":
        found = ahead
    else:
        rows = rows.withColumn("__back", back).withColumn("__ahead", ahead)
        nearer = F.col(f"__ahead.{right_on}") - F.col("__at") < F.col("__at") - F.col(f"__back.{right_on}")
        found = F.when(F.col("__back").isNull() | nearer, F.col("__ahead")).otherwise(F.col("__back"))
    return rows.withColumn("found", found).where(side).select("__left.*", "found")
