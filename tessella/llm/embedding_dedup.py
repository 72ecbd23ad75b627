"""Embedding near-duplicates by collision-counting projections.

Vectors are compared where their labels (and dimensions) are equal.  Equal vectors are taken together
first.  A label with more than `CELL` vectors is dealt into cells by the signs of k random projections,
in as many tables as give two vectors at the threshold `RECALL`; k grows with the logarithm of the
label's size, so a cell stays about as large.  A cell with more than `BLOCK` vectors is cut into blocks,
and each pair of blocks is a group of its own, so no task holds more than two blocks.

Within a group, both sides' vectors are sorted along each of `PROJECTIONS` orthogonal directions, the one with the
greatest spread first.  A vector of one side opens a window around its own place in each.  Windows along the first
`SIEVE` directions are so wide that hardly a pair at the threshold misses one; a strip of vectors that are near
each other along the first direction meets only the stretch of it that these windows reach, and only pairs that share
all of them are looked at further: a few in a hundred.  Their collisions in narrower windows along the other directions are
counted one direction after the other, and a pair is left as soon as those to come can't
lift it to the least count.  Widths and least count are set so that a pair at the threshold passes with
probability `RECALL`; pairs that pass are verified by their cosine in double precision.  A pair is
counted in the first table where it shares a cell.  Groups give each vector's number of links and a
spanning forest of their links, never their pairs; components follow from these in Spark.

With exact=True no link is missed: a label is one cell whatever its size (in blocks, so memory stays bounded), and windows are as wide
as the distance at the threshold, which no link exceeds along any direction.

Defined cases: a vector without label, null, empty, zero or with a null or non-finite component has no
links and is its own component; a null id is larger than any other; equal vectors count as links of each
other; vectors of unequal dimensions aren't compared; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.tables import cut, join_groups

THRESHOLD = 0.98
CELL = BLOCK = 8_192
#: Directions, and how many of them all windows must be shared in; half the widths of those windows and of the others, in deviations at the threshold.
PROJECTIONS, SIEVE, WIDE, NARROW = 24, 4, 3.9, 2.5
#: Vectors of a strip; pairs that are verified at once.
STRIP, VERIFY = 128, 20_000
RECALL = 0.9995
SEED = 5
#: As many large cells are broadcast with their sizes; more are joined by shuffling.
BROADCAST_CELLS = 50_000


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """Orthogonal directions, one a column."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0][:, :PROJECTIONS]


@lru_cache(maxsize=8)
def sign_directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((dim, n))


def window(dim: int, threshold: float, exact: bool = False) -> tuple[float, float, int]:
    """Half the widths of windows that all must be shared and of those that are counted, and the least count of these."""
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    deviation = distance / math.sqrt(dim)
    sieve, counted = min(SIEVE, dim), max(0, min(PROJECTIONS, dim) - SIEVE)
    wide, narrow = (distance, distance) if exact else (min(distance, WIDE * deviation), min(distance, NARROW * deviation))
    within = lambda half: 1.0 if half >= distance else math.erf(half / deviation / math.sqrt(2))
    p, chance = within(narrow), within(wide) ** sieve
    tail, least = 0.0, counted
    while least >= 0:
        tail += math.comb(counted, least) * p**least * (1 - p) ** (counted - least)
        if tail * chance >= RECALL:
            break
        least -= 1
    return wide + 1e-9, narrow + 1e-9, max(0, least)


def tables(n: int, threshold: float, cell: int | None) -> tuple[int, int]:
    """Signs per table and number of tables for a label of n vectors, in cells of about so many (None: one cell)."""
    signs = max(0, math.ceil(math.log2(max(1, n) / cell))) if cell else 0
    if not signs:
        return 0, 1
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** signs
    return signs, 1 if together >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - together))


def units(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _cells(batches: Iterator[pa.RecordBatch], threshold: float, cell: int | None) -> Iterator[pa.RecordBatch]:
    """Each vector once for each table: cell, table, key, weight, unit, signs (of all tables)."""
    for batch in batches:
        vectors, in_label = batch.column("vector"), batch.column("in_label").to_numpy()
        dims, ends = np.diff(vectors.offsets.to_numpy()), vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False)
        label = np.array(batch.column("label").to_pylist(), object)
        for dim, size in sorted(set(zip(dims.tolist(), in_label.tolist(), strict=True))):
            own = np.nonzero((dims == dim) & (in_label == size))[0]
            unit = units(values[ends[own][:, None] + np.arange(dim)])
            k, n = tables(size, threshold, cell)
            bits = unit @ sign_directions(dim, k * n) >= 0 if k else np.zeros((len(own), 0), bool)
            signs = (bits.reshape(len(own), n, k) @ (1 << np.arange(k, dtype=np.int64))).astype("<i8") if k else np.zeros((len(own), 1), "<i8")
            rows = batch.take(pa.array(own))
            for t in range(n):
                cells = [f"{x}/{dim}/{t}/{v}" for x, v in zip(label[own], signs[:, t], strict=True)]
                columns = [pa.array(cells, pa.string()), pa.array(np.full(len(own), t, np.int32)), rows.column("key"), rows.column("weight"), _binary(unit.astype("<f8")), _binary(signs)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "table", "key", "weight", "unit", "signs"])


def linked(a: np.ndarray, b: np.ndarray, threshold: float, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of linked rows (units), strip by strip of a."""
    wide, narrow, least = window(a.shape[1], threshold, exact)
    axes = directions(a.shape[1])
    at_a, at_b = a @ axes, b @ axes
    spread = np.argsort(-at_b.var(axis=0), kind="stable")
    at_a, at_b = at_a[:, spread], at_b[:, spread]
    count, sieve = at_a.shape[1], min(SIEVE, at_a.shape[1])
    order, queue = np.argsort(at_b[:, 0], kind="stable"), np.argsort(at_a[:, 0], kind="stable")
    at_b = at_b[order]
    place = np.empty((count, len(at_b)), np.int32)  # each row's place along each direction
    lows, sizes = np.empty((count, len(at_a)), np.int32), np.empty((count, len(at_a)), np.uint32)  # the first place in each window, and how many it holds
    for k in range(count):
        half = wide if k < sieve else narrow
        along = np.argsort(at_b[:, k], kind="stable")
        place[k, along] = np.arange(len(along))
        lows[k] = np.searchsorted(at_b[along, k], at_a[:, k] - half, "left")
        sizes[k] = np.searchsorted(at_b[along, k], at_a[:, k] + half, "right") - lows[k]
    for begin in range(0, len(queue), STRIP):
        strip = queue[begin : begin + STRIP]
        low = int(lows[0, strip[0]])
        high = int(lows[0, strip[-1]] + sizes[0, strip[-1]])
        near = np.ones((len(strip), high - low), bool)
        for k in range(sieve):
            near &= (place[k, None, low:high] - lows[k, strip, None]).view(np.uint32) < sizes[k, strip, None]
        i, j = np.nonzero(near)
        i, j = strip[i], j + low
        hits = np.zeros(len(i), np.int8)
        for k in range(sieve, count):
            hits += (place[k, j] - lows[k, i]).view(np.uint32) < sizes[k, i]
            alive = hits >= least - (count - k - 1)
            i, j, hits = i[alive], j[alive], hits[alive]
        j = order[j]
        for part in range(0, len(i), VERIFY):
            own, other = i[part : part + VERIFY], j[part : part + VERIFY]
            near = np.einsum("ij,ij->i", a[own], b[other]) >= threshold
            yield own[near], other[near]


def join_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the roots (each number's, none above it) of what the links i, j connect the least of them."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def _count_links(table: pa.Table, threshold: float, exact: bool) -> pa.Table:
    """Of one pair of blocks: rows (a, n, null) with a's links, and rows (a, 0, b) of a spanning forest."""
    block, table_nr = table.column("block").to_numpy(), table.column("table")[0].as_py()
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    key, weight = np.array(table.column("key").to_pylist(), object), table.column("weight").to_numpy()
    unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f8").reshape(len(key), -1)
    signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), "<i8").reshape(len(key), -1)[:, :table_nr]
    a, b = np.nonzero(block == first)[0], np.nonzero(block == second)[0]
    links, roots = np.zeros(len(key), np.int64), np.arange(len(key))
    if len(a) and len(b):
        for i, j in linked(unit[a], unit[b], threshold, exact):
            i, j = a[i], b[j]
            new = (i != j) & (signs[i] != signs[j]).all(axis=1)  # not counted in an earlier table
            i, j = i[new], j[new]
            links += np.bincount(i, weight[j], len(key)).astype(np.int64)
            if first != second:
                links += np.bincount(j, weight[i], len(key)).astype(np.int64)
            join_roots(roots, i, j)
    some, tied = np.nonzero(links)[0], np.nonzero(roots != np.arange(len(key)))[0]
    return pa.table({
        "a": pa.array([*key[some], *key[tied]], pa.string()), "n": pa.array(np.append(links[some], np.zeros(len(tied), np.int64))),
        "b": pa.array([None] * len(some) + list(key[roots[tied]]), pa.string()),
    })


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(id, n_links, component_id), one row per row of vectors; exact: without the chance of missing a link."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0)
    key = F.when(F.coalesce(good, F.lit(False)), F.md5(F.concat_ws(",", F.col("label"), F.col("vector").cast("array<string>"))))
    rows = rows.withColumn("key", key)
    total = rows.count()
    distinct = cut(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    labels = distinct.groupBy("label").agg(F.count("*").alias("in_label"))
    sized = join_groups(distinct, labels, "label", "in_label", total)
    cells = sized.select("key", "label", "vector", "weight", "in_label").mapInArrow(partial(_cells, threshold=threshold, cell=None if exact else CELL), "cell string, table int, key string, weight long, unit binary, signs binary")
    large = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select(F.col("cell").alias("large"), "blocks"))
    large = F.broadcast(large) if large.count() <= BROADCAST_CELLS else large
    cells = cells.join(large, F.col("cell") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "table", "key", "weight", "unit", "signs", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def count_links(table: pa.Table) -> pa.Table:
        return _count_links(table, threshold, exact)

    found = cut(cells.groupBy("cell", "first", "second").applyInArrow(count_links, "a string, n long, b string"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "key")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    groups = distinct.select("key", "weight", "first_id").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = groups.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    groups = join_groups(groups, firsts, "root", "members", total).select("key", "weight", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return join_groups(rows.where("key is not null"), groups, "key", "weight", total).select("id", "n_links", "component_id").unionByName(alone)
