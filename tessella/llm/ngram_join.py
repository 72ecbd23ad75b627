"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word n-grams as 64-bit hashes.  In one global order of all n-grams,
two sets that reach the threshold share one of their first |x| - ceil(t |x|) + 1 elements, their
prefixes.  The order: n-grams whose hash is in the lowest `SLACK` (1 - t) of all hashes, the band, from
rare to frequent; then all others by hash.  A prefix is thus nearly always a part of the set's elements
in the band, and takes the rarest of these.

1. One pass over the texts: each set's size, fingerprint and first elements by hash (all in the band, or
   a prefix if that is more).  Equal sets are one from here on.
2. Elements are counted over all sets; those of one set alone link nothing and stay where they are.
   What is left of the prefixes is grouped by element.  The group's first set is its hub, and the
   memberships (hub, set), each once, make bundles: any two sets that share an element of their prefixes
   are together in the bundle of that element's hub.
3. The sets of a bundle, rebuilt from their texts, go into a prefix tree and traverse it (`prefix_tree`).
   Only links that join two components come out.  Small bundles share a task; a large one is dealt into
   blocks of at most about `BLOCK` n-grams and `BLOCK_SETS` sets, each with the hub.
4. In a bundle of several blocks, the sets that are not in the hub's component by now meet all others of
   sizes that can be linked with theirs, block by block.

Every link between different sets is either found or lies within one component that other links already
connect, so components are exact.  Pairs of documents are never rows.

The documents are read several times and must then be the same rows in the same partitions, as those of
a table or of files are; write the outcome of a shuffle first.

Defined cases: without words or text a document is empty and linked with nothing; with fewer words than
n the whole sequence is its one n-gram; a null id is larger than any other; documents with equal ids
are documents of their own; other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.measure import Measure
from tessella.llm.prefix_tree import spanning_links
from tessella.llm.shingles import fingerprint, sets_of
from tessella.llm.tables import among, cut, join_groups, numbered, texts_in_small_batches, without

#: The band holds so many times the elements that prefixes take.
SLACK = 1.5
#: N-grams and sets of a block.
BLOCK, BLOCK_SETS = 100_000, 400
#: Row numbers to look up that are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 500_000


# ---- passes over the texts

def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def first_elements(found: np.ndarray, measure: Measure) -> tuple[int, np.ndarray]:
    """How many elements are in the band; those and, if they are fewer than the prefix, others up to its length."""
    band = np.uint64(int(SLACK * (1 - measure.num / measure.den) * (1 << 63)))
    inside = int(np.searchsorted(found, band))
    return inside, found[: max(inside, measure.prefix(len(found)))]


def _describe(batches: Iterator[pa.RecordBatch], measure: Measure) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, inside, grams = [], [], [], []
        for found in sets_of(batch.column("text"), measure.n):
            in_band, first = first_elements(found, measure) if len(found) else (0, found)
            sizes.append(len(found))
            keys.append(fingerprint(found) if len(found) else None)
            inside.append(in_band)
            grams.append(first)
        yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(inside, pa.int64()), _lists(grams)], names=["nth", "id", "size", "key", "inside", "grams"])


def _with_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (nth, ..) with the text of each row number."""
    wanted = cut(wanted)
    numbers = wanted.select("nth").distinct()
    if numbers.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(numbers.withColumnRenamed("nth", "wanted")), F.col("nth") == F.col("wanted"), "left_semi")
    else:
        texts = numbered(texts, "nth", numbers)
    return wanted.join(texts.select("nth", "text"), "nth")


def _link_bundles(table: pa.Table, measure: Measure) -> pa.Table:
    """Links (a, b) within each bundle of rows (hub, nth, part, home, probe, text): between sets of different parts of which one is a probe.

    home: the set is known to be connected with the hub."""
    out: list[tuple[int, int]] = []
    table = table.sort_by([("hub", "ascending"), ("nth", "ascending")]).combine_chunks()
    hubs, names, parts, home, probe = (table.column(c).to_pylist() for c in ("hub", "nth", "part", "home", "probe"))
    begin = 0
    for end in range(1, len(hubs) + 1):
        if end < len(hubs) and hubs[end] == hubs[begin]:
            continue
        sets = [s for chunk in table.column("text").slice(begin, end - begin).chunks for s in sets_of(chunk, measure.n)]
        own, numbers = names[begin:end], {}
        group = [numbers.setdefault(p, len(numbers)) for p in parts[begin:end]]
        probes = sorted((k for k in range(len(own)) if probe[begin + k]), key=lambda k: not home[begin + k])  # noqa: B023
        known = next((k for k in range(len(own)) if home[begin + k]), None)
        out += [(own[a], own[b]) for a, b in spanning_links(sets, measure, group, known, probes)]
        begin = end
    a, b = list(zip(*out, strict=True)) or [(), ()]
    return pa.table({"a": pa.array(map(str, a), pa.string()), "b": pa.array(map(str, b), pa.string())})


def _linked(rows: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Links within the bundles of rows (task, hub, nth, part, home, probe)."""

    def link(table: pa.Table) -> pa.Table:
        return _link_bundles(table, measure)

    rows = _with_texts(rows, texts).select("task", "hub", "nth", "part", "home", "probe", "text")
    return cut(rows.groupBy("task").applyInArrow(link, "a string, b string"))


# ---- the join

def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, written down, and to be broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def _prefixes(sets: DataFrame, measure: Measure) -> DataFrame:
    """(gram, nth, size, place): the elements of prefixes that other sets have too, with their places in the global order of the set."""
    counts = cut(sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    rows = sets.select(F.posexplode("grams").alias("at", "gram"), "nth", "size", "inside")
    rows = among(rows, "gram", counts).join(counts, "gram").withColumn("banded", F.col("at") < F.col("inside"))
    own = Window.partitionBy("nth")
    rows = rows.withColumn("alone", F.col("inside") - F.sum(F.col("banded").cast("long")).over(own))  # elements in the band that no other set has come first
    nth_of = F.row_number().over(own.orderBy(F.desc("banded"), F.when(F.col("banded"), F.col("n")), "gram"))
    rows = rows.withColumn("place", F.when(F.col("banded"), F.col("alone") + nth_of - 1).otherwise(F.col("at")))
    return rows.where(measure.in_prefix(F.col("place"), F.col("size"))).select("gram", "nth", "size", "place")


def _memberships(sets: DataFrame, measure: Measure) -> DataFrame:
    """(hub, nth, size): the sets of each bundle, with the hub itself, whose name is its nth as a string."""
    rows = cut(_prefixes(sets, measure))
    groups = rows.groupBy("gram").agg(F.min(F.struct("nth", "size", "place")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(groups, "gram").where(F.col("nth") != F.col("hub.nth"))
    # of two sets alone with the first element that they share, so much must still be able to follow in both
    overlap = 1 + F.least(F.col("size") - F.col("place"), F.col("hub.size") - F.col("hub.place")) - 1
    rows = rows.where((F.col("n") > 2) | measure.alike(F.col("size"), F.col("hub.size")) & measure.enough(overlap, F.col("size"), F.col("hub.size")))
    pair = F.array(F.struct(F.col("nth").alias("nth"), F.col("size").alias("size")), F.struct("hub.nth", "hub.size"))
    rows = rows.select(F.col("hub.nth").cast("string").alias("hub"), F.explode(pair).alias("x")).select("hub", "x.nth", "x.size")
    return cut(rows.distinct())


def _bundle_links(members: DataFrame, bundles: DataFrame, total: int, texts: DataFrame, measure: Measure) -> DataFrame:
    """Step 3: links within bundles and blocks, of each block's sets and the hub."""
    tasks = math.ceil((bundles.where("blocks = 1").agg(F.sum("grams")).first()[0] or 0) / BLOCK) or 1
    rows = join_groups(members, bundles.select("hub", "n", "blocks"), "hub", "n", total)
    alone = rows.where("blocks = 1").select(F.concat(F.lit("shared "), F.pmod(F.xxhash64("hub"), F.lit(tasks))).alias("task"), "hub", "nth")
    dealt = rows.where((F.col("blocks") > 1) & (F.col("nth").cast("string") != F.col("hub"))).select(F.concat_ws(" ", "hub", F.pmod(F.xxhash64("nth"), F.col("blocks"))).alias("task"), "hub", "nth")
    hubs = bundles.where("blocks > 1").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.unionByName(hubs.select(F.concat_ws(" ", "hub", "block").alias("task"), "hub", F.col("hub").cast("long").alias("nth")))
    name = F.col("nth").cast("string")
    return _linked(alone.unionByName(dealt).select("*", name.alias("part"), (name == F.col("hub")).alias("home"), F.lit(True).alias("probe")), texts, measure)


def _stray_links(members: DataFrame, bundles: DataFrame, links: DataFrame, total: int, texts: DataFrame, measure: Measure) -> DataFrame | None:
    """Step 4: links between the sets of a bundle of several blocks that aren't in its hub's component, and all others of it."""
    large = _small(bundles.where("blocks > 1").select("hub", "n"))
    if large.isEmpty():
        return None
    roots = components(links)
    rows = members.join(large.select("hub"), "hub", "left_semi").withColumn("own", F.col("nth").cast("string"))
    rows = rows.join(roots.select(F.col("node").alias("own"), "root"), "own", "left").withColumn("part", F.coalesce("root", "own")).drop("root")
    of_hub = large.join(roots.select(F.col("node").alias("hub"), "root"), "hub", "left").select("hub", "n", F.coalesce("root", "hub").alias("hub_part"))
    rows = join_groups(rows, of_hub, "hub", "n", total).withColumn("stray", F.col("part") != F.col("hub_part"))
    width = 1.001 * math.log(measure.den / measure.num)  # sets that can be linked are in the same bucket or in adjoining ones
    rows = cut(rows.select("hub", "nth", "size", "part", "stray", F.floor(F.log("size") / width).alias("bucket")))

    def blocks(sizes, n):
        return F.ceil(F.greatest(F.sum(sizes) / BLOCK, F.sum(n) / BLOCK_SETS)).cast("int")

    one = F.col("stray").cast("long")
    buckets = cut(rows.groupBy("hub", "bucket").agg(blocks(F.col("size"), F.lit(1)).alias("blocks"), blocks(F.col("size") * one, one).alias("strays")))
    pairs = buckets.where("strays > 0").select("hub", F.col("bucket").alias("a"), "strays", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("b"))
    pairs = _small(pairs.join(buckets.select("hub", F.col("bucket").alias("b"), "blocks"), ["hub", "b"]))

    def dealt(rows: DataFrame, side: str, own: str, others: str, probe: bool) -> DataFrame:
        rows = rows.withColumn(side, F.col("bucket")).join(pairs, ["hub", side])
        mine = F.pmod(F.xxhash64("nth"), F.col(own))
        rows = rows.select("hub", "nth", "part", "stray", "a", "b", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))
        at = ("mine", "other") if probe else ("other", "mine")
        return rows.select(F.concat_ws(" ", "hub", "a", "b", *at).alias("task"), "hub", "nth", "part", (~F.col("stray")).alias("home"), F.lit(probe).alias("probe"))

    both = dealt(rows.where("stray"), "a", "strays", "blocks", True).unionByName(dealt(rows, "b", "blocks", "strays", False))
    both = both.groupBy("task", "hub", "nth").agg(F.first("part").alias("part"), F.first("home").alias("home"), F.max("probe").alias("probe"))
    return _linked(both, texts, measure)


def _all_links(sets: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) between sets, named by their nth as strings, that connect all components."""
    members = _memberships(sets, measure)
    total = members.count()
    blocks = F.ceil(F.greatest(F.col("grams") / BLOCK, F.col("n") / BLOCK_SETS)).cast("int")
    bundles = cut(members.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).withColumn("blocks", blocks))
    links = _bundle_links(members, bundles, total, texts, measure)
    more = _stray_links(members, bundles, links, total, texts, measure)
    return links if more is None else links.unionByName(more)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """(nth, id, n_shingles, component_id, stays), one row per row of docs.

    nth is the row's monotonically_increasing_id(); stays: whether it is the first of its component by id."""
    texts = texts_in_small_batches(docs).select(F.monotonically_increasing_id().alias("nth"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    features = cut(texts.mapInArrow(partial(_describe, measure=measure), f"nth long, id {kind}, size long, key string, inside long, grams array<long>"))
    rows = features.select("nth", "id", "size", "key")
    alone = rows.where("key is null").select("nth", "id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    rows = rows.where("key is not null")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "nth")
    by_key = cut(rows.groupBy("key").agg(F.min(place).alias("first"), F.min("nth").alias("rep"), F.count("*").alias("n")))
    firsts = _small(by_key.select(F.col("rep")))
    links = _all_links(features.join(firsts, F.col("nth") == F.col("rep"), "left_semi"), texts, measure)
    roots = _small(components(links).withColumnRenamed("node", "own"))
    by_key = by_key.withColumn("own", F.col("rep").cast("string")).join(roots, "own", "left").withColumn("root", F.coalesce("root", "own"))
    by_root = by_key.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("members"))
    total = features.count()
    by_key = join_groups(by_key.select("key", "n", "root"), by_root, "root", "members", total).select("key", "n", "best")
    marked = join_groups(rows, by_key, "key", "n", total)
    marked = marked.select("nth", "id", F.col("size").alias("n_shingles"), F.col("best.id").alias("component_id"), (F.col("nth") == F.col("best.nth")).alias("stays"))
    return marked.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """The rows of docs without those of which a row with a smaller id is in the same component."""
    return without(docs, cut(near_components(docs, id_col, text_col, measure).where("not stays").select("nth")))
