"""Openings of a recording said again: at its end as alternates, near its start as retakes, and what each leaves to be cut."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.operators import fuzzy


def first_openings(clauses: DataFrame, by: str) -> DataFrame:
    """clauses (by, idx, start_ms, opening) with how their key opens (said) and when (at), and whether they open alike."""
    first = clauses.groupBy(by).agg(F.min_by(F.struct("opening", "start_ms"), "idx").alias("first"))
    rows = clauses.join(first, by).select(*clauses.columns, F.col("first.opening").alias("said"), F.col("first.start_ms").alias("at"))
    return rows.withColumn("alike", fuzzy.alike(F.col("said"), F.col("opening")))


def alternates(rows: DataFrame, by: str, sizes: DataFrame, apart_ms: int, longest: int) -> DataFrame:
    """Of first_openings: (by, idx, last), the takes of the opening at the end of a key (sizes: by, n words).

    A take begins over apart_ms after the first and goes on until the next or the end; walking back from the end, it ends with the first that has
    over `longest` words, since that one goes on into something else."""
    hits = rows.where(F.col("alike") & (F.col("start_ms") - F.col("at") > apart_ms)).select(by, "idx").join(sizes, by)
    order = W.partitionBy(by).orderBy("idx")
    hits = hits.withColumn("last", F.coalesce(F.lead("idx").over(order), F.col("n") + 1) - 1)
    later = W.partitionBy(by).orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)
    return hits.withColumn("short", F.min((F.col("last") - F.col("idx") + 1 <= longest).cast("int")).over(later) == 1).where("short").select(by, "idx", "last")


def go_alike(x: Sequence[str], y: Sequence[str], gap: int = 3) -> tuple[int, int]:
    """How far x and y go alike from their starts: runs of equal words (two at least, but for the first), each begun at most gap words after the one before on both sides."""
    i = j = 0
    while True:
        steps = sorted((a + b, a) for a in range(gap + 1) for b in range(gap + 1))
        for both, a in steps:
            n = 0
            while i + a + n < len(x) and j + both - a + n < len(y) and x[i + a + n] == y[j + both - a + n]:
                n += 1
            if n >= (2 if i else 1):
                i, j = i + a + n, j + both - a + n
                break
        else:
            return i, j


def _ends(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([list(go_alike(list(a), list(b))) for a, b in zip(x, y, strict=True)], dtype="object")


def ends_alike(x: Column, y: Column) -> Column:
    """go_alike of two arrays, as an array of two."""
    return pandas_udf(_ends, "array<int>")(x, y)


def without_lesser(rows: DataFrame, by: str, width: int = 0) -> DataFrame:
    """rows (by, b, e, rank and others; b < e) without those that meet one of a smaller rank.

    A row stands beside each larger rank of its key too.  What meets it then begins before it and ends after its start, or begins in it: the latest end so far and the next start say so, and nothing is joined.
    width is what buckets of a join would need; windows don't."""
    each = rows.withColumn("__ranks", F.collect_set("rank").over(W.partitionBy(by)))
    each = each.withColumn("__for", F.explode(F.filter("__ranks", lambda r: r >= F.col("rank")))).drop("__ranks")
    better = F.col("rank") < F.col("__for")
    upto, ahead = (W.partitionBy(by, "__for").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow) for order in ("b", F.desc("b")))
    each = each.withColumn("__ends", F.max(F.when(better, F.col("e"))).over(upto)).withColumn("__begins", F.min(F.when(better, F.col("b"))).over(ahead))
    beaten = F.coalesce(F.col("__ends") > F.col("b"), F.lit(False)) | F.coalesce(F.col("__begins") < F.col("e"), F.lit(False))
    return each.where(~better & ~beaten).select(rows.columns)
