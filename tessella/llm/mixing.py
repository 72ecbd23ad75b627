"""Mixing sources to target weights, in DataFrame functions only.

Sources are ranked by code point (null last) and weigh 5, 2, 1, 5, 2, 1, ...  They share `SHARE` times
all words by weight, but no target exceeds `MOST` times its source's size; what is above goes to the
others by weight until none is above.  That fixed point is a water level: with the sources in order of
cap / weight, a source is capped where its cap / weight is at most what the rest would get per weight.

A source gives complete epochs first, as many as its target holds.  For the rest of its target its
documents are put in the order of Efraimidis-Spirakis keys -ln(u) / quality, u being a hash of the
document's id, and taken from the smallest until the budget ends; the document at the end gives a part.
The place where a source's budget ends is found by prefix sums over three levels: 256 ranges of the
key, 256 parts of one range, the documents of one part.  No level puts a whole source in one task, and
the documents are compared with the end of their source without being shuffled.

Defined cases: a null text has no words; documents without words take nothing; a null source is a
source; identical rows (same source, id and size) at the end share what is left evenly, rounded down;
other columns are carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.tables import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
PARTS = 256
#: As many sources' budgets are broadcast (about 100 bytes each); more are joined by shuffling.
BROADCAST_SOURCES = 20_000


def count_words(text: Column) -> Column:
    """How many runs of characters other than white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document from two signals, each a factor from a quarter to 1: words of 3 to 12 characters on average, and enough words to say something.

    Both come from the counts that are made anyway, so no text is copied for them."""
    mean = F.try_divide(F.length(text), size)
    shape = F.when(mean.between(3, 12), 1.0).otherwise(0.25)
    long = F.least(F.lit(1.0), 0.25 + size / 40.0)
    return shape * long


def sampling_key(id_: Column, weight: Column) -> Column:
    """1 - exp(-E) of the exponential key E = -ln(u) / weight: in the same order, and in [0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(SEED)), 11) + 1) / F.lit(float((1 << 53) + 1))
    return F.lit(1.0) - F.pow(u, F.lit(1.0) / weight)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Of (source, size): (source, source_size, target), one row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * MOST)
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("level", left / weight_left)
    sources = sources.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return sources.select("source", "source_size", target.alias("target"))


def _end(sums: DataFrame, budgets: DataFrame, by: str) -> DataFrame:
    """Where each source's budget (source, left) ends among sums (source, by, words): (source, at, left), left being what is over at that place."""
    sums = sums.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy(by)) - F.col("words"))
    found = sums.join(budgets, sums["source"].eqNullSafe(budgets["source"])).where("before <= left and left < before + words")
    return found.select(sums["source"], F.col(by).alias("at"), (F.col("left") - F.col("before")).alias("left"))


def source_ends(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Of rows (source, id, size, key): targets with epochs, and where the last epoch's part ends: cut_key, cut_id, cut_words (none: nulls, nothing taken)."""
    words = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs).withColumn("left", words - epochs * F.col("source_size"))
    part = F.least(F.floor(F.col("key") * PARTS * PARTS), F.lit(PARTS * PARTS - 1)).cast("int")
    rows = rows.where("size > 0").withColumn("part", part)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words")).withColumn("range", F.floor(F.col("part") / PARTS))
    ranges = parts.groupBy("source", "range").agg(F.sum("words").alias("words"))
    end = _end(ranges, targets.select("source", "left"), "range")
    inside = parts.join(end.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("at")), "left_semi")
    end = _end(inside, end.select("source", "left"), "part")
    inside = rows.join(end.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("at")), "left_semi")
    place = F.struct("key", "id", "size").alias("place")
    inside = inside.groupBy("source", place).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    counts = inside.select(F.col("source").alias("s"), F.col("place").alias("p"), "n")
    end = _end(inside.drop("n"), end.select("source", "left"), "place")
    end = end.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("p")))
    end = end.select(F.col("source").alias("s"), "at", F.floor(F.col("left") / F.col("n")).alias("cut_words"))
    return targets.join(end, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "at", "cut_words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), id, size, source_size, target (of its source), epochs, part (words of the last, partial epoch), taken (words in all)."""
    size = count_words(docs[text_col])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), docs[id_col].alias("id"), size.alias("size"), docs[text_col].alias("text"))
    rows = rows.withColumn("key", sampling_key(F.col("id"), quality(F.col("text"), F.col("size")))).drop("text")
    slim = cut(rows.select("source", "id", "size", "key"))
    ends = cut(source_ends(slim, source_targets(slim)))
    ends = ends.withColumnRenamed("source", "s")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    place = F.struct("key", "id", "size")
    part = F.when(F.col("at").isNull() | (place > F.col("at")), F.lit(0)).when(place < F.col("at"), F.col("size")).otherwise(F.col("cut_words"))
    mixed = rows.join(ends, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.when(F.col("size") > 0, part).otherwise(F.lit(0)).cast("long"))
    return mixed.select("row", "id", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; a row of which it takes a part stays whole if that is half of it or more."""
    mixed = mix(docs, id_col, text_col, source_col)
    copies = (F.col("epochs") + ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("long")).cast("int")
    return mixed.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
