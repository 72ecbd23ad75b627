"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

The texts are read once: each row's number, id and SHA-256 are written down, in shards of about
`SHARD_ROWS` rows by a hash of the digest.  Shard by shard, pass one marks `PROBES` slots of a table of
`FILTER_BITS` bits for each digest; slots marked by two rows or more make up the filter of repeated
slots.  Pass two tests each row against that filter: a row with one slot that nobody else marked can
have no copy and passes straight through, and only the other rows shuffle, to be grouped by digest.

A filter has eight bits a row and takes 8 MB at most, whatever the input; with more rows there are more
shards.  Shards are tested one after the other, each in a job of its own that writes its outcome down, so that only one
filter is broadcast at a time and plans don't grow with the number of shards.

What pass one shuffles are slots (two numbers a row, those that a task has twice once), not rows.  Whole bitmaps of each task instead
would be more bytes as soon as a shard has over three tasks (8 bits a row of the *shard* from each task), and no built-in aggregate marks what it has seen twice.

Defined cases: a null text counts as empty; a null id is smaller than any other; of rows with the same
text and the same id exactly one is kept; other columns, whatever their names, are carried as they are;
an empty table gives an empty result.  `drop_copies` reads its input twice, so that must be files or a
table, with the same rows in the same partitions each time.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import bit, bitmaps, cut, join_groups, shared_dir, without, written

FILTER_BITS = 1 << 26
SHARD_ROWS = FILTER_BITS // 8
PROBES = 2


def _slots(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(FILTER_BITS)) for seed in range(PROBES)]


def repeated_slots(rows: DataFrame) -> DataFrame:
    """Of rows (digest): the bitmaps (bucket, bitmap) of the slots that two rows or more mark."""
    slots = rows.select(F.explode(F.array(*_slots(F.col("digest")))).alias("slot"))
    return bitmaps(slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot"))


def _with_suspicion(rows: DataFrame) -> DataFrame:
    """rows and suspect: whether all slots of the row's digest are in the filter."""
    kept = rows.columns
    filters = F.broadcast(cut(repeated_slots(rows)))
    hit = F.lit(True)
    for k, slot in enumerate(_slots(F.col("digest"))):
        found = filters.select(F.col("bucket").alias(f"bucket{k}"), F.col("bitmap").alias(f"bitmap{k}"))
        rows = rows.join(found, F.bitmap_bucket_number(slot + 1) == F.col(f"bucket{k}"), "left")
        hit &= F.coalesce(bit(F.col(f"bitmap{k}"), slot), F.lit(False))
    return rows.select(*kept, hit.alias("suspect"))


def _shards(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[DataFrame], int]:
    """(nth, id, digest) of all rows, in shards, and how many rows there are."""
    total = docs.count()
    shards = max(1, math.ceil(total / SHARD_ROWS))
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), docs[id_col].alias("id"), digest.alias("digest"))
    if shards == 1:
        return [written(rows)], total
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("digest", F.lit(PROBES)), F.lit(shards)).cast("int")), "shard")
    return [rows.where(F.col("shard") == k).drop("shard") for k in range(shards)], total


def _tested(shards: list[DataFrame]) -> DataFrame:
    """All shards with suspicion, one after the other."""
    if len(shards) == 1:
        return _with_suspicion(shards[0])
    spark = shards[0].sparkSession
    at = f"{shared_dir(spark)}/tested-{uuid.uuid4().hex}"
    for rows in shards:
        tested = _with_suspicion(rows)
        tested.write.mode("append").parquet(at)
    return spark.read.schema(tested.schema).parquet(at)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: nth (its monotonically_increasing_id()), id, digest (lower-case hex), keep_id, group_size, kept.

    Of equal texts, the row with the largest id is kept."""
    shards, total = _shards(docs, id_col, text_col)
    tested = _tested(shards)
    single = tested.where("not suspect").select("nth", "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = tested.where("suspect").select("nth", "id", F.hex("digest").alias("digest"))
    groups = cut(maybe.groupBy("digest").agg(F.max(F.struct("id", "nth")).alias("best"), F.count("*").alias("group_size")))
    several = join_groups(maybe, groups, "digest", "group_size", total).select(
        "nth", "id", F.unhex("digest").alias("digest"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("nth") == F.col("best.nth"))).alias("kept"),
    )
    return single.unionByName(several).withColumn("digest", F.lower(F.hex("digest")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose text another kept row has."""
    return without(docs, cut(mark_copies(docs, id_col, text_col).where("not kept").select("nth")))
