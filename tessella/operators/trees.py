"""Nested documents of any depth: a walk level by level, as joins with each value's own children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lineage import cut

#: A document that nests deeper than this is taken for broken.
DEEPEST = 100


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, or the type of a single value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def walk(df: DataFrame, by: Sequence[str], json: str, skip: Sequence[str] = ()) -> DataFrame:
    """Every value of the documents in column json but the documents themselves: (by, path, key, kind, value), key being the nearest name above or at it.

    What stands under a name of skip is left out.  Text that isn't JSON, and null, have no values.  One join a level; a level's containers are written
    down, so that the next doesn't parse again, and an empty level ends the walk."""
    spark = df.sparkSession
    level = df.select(*by, F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(json)).alias("value")).where("value is not null")
    found: list[DataFrame] = []
    for _ in range(DEEPEST):
        level = level.withColumn("kind", _kind(F.col("value"))).where(F.col("kind").isin("OBJECT", "ARRAY"))
        level = cut(level.select(*by, "path", "key", "value"))
        if level.isEmpty():
            break
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "__name", "__value"))
        named = F.col("__name").isNotNull()
        path = F.concat("path", F.when(named, F.concat(F.lit("."), F.col("__name"))).otherwise(F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))))
        inner = inner.select(*by, path.alias("path"), F.coalesce("__name", "key").alias("key"), F.col("__value").alias("value"))
        level = inner.where(F.col("key").isNull() | ~F.col("key").isin(*skip)) if skip else inner
        found.append(level)
    else:
        raise ValueError(f"a document nests deeper than {DEEPEST}")
    if not found:
        found = [level.select(*by, "path", "key", "value")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(*by, "path", "key", _kind(F.col("value")).alias("kind"), "value")


def texts(df: DataFrame, by: Sequence[str], json: str, skip: Sequence[str] = ()) -> DataFrame:
    """(by, path, key, text) of all texts in the documents."""
    rows = walk(df, by, json, skip).where("kind = 'STRING'")
    return rows.select(*by, "path", "key", F.col("value").cast("string").alias("text"))
