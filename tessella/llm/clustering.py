"""Centroid clustering by plain Lloyd rounds on integers.

Vectors of `dim` components become integers floor(scale * x).  The first centroids are the vectors whose
hash of seed and id is smallest.  A round broadcasts the centroids (k x dim integers, whatever the input);
every task subtracts them from its vectors one after the other, sums the squared differences in 64 bits,
takes the nearest (of equally near ones the lowest number), and gives one row of sums per centroid.  Those
merge through groupBy, so at most k rows a task shuffle, and k rows come to the driver, where a centroid
becomes the exact floor of the mean.  Nothing depends on the order of rows, so reruns agree.

Defined cases: a vector that is null, has another number of components, or one that is null or not finite
is left out; a component beyond `LIMIT` after scaling counts as LIMIT, so that distances stay within 64 bits;
a null id hashes as `null`; of vectors with equal hashes the smaller one comes first; with fewer vectors than
k there are as many centroids as vectors; a sum of distances beyond 64 bits is null; rows with the same id are assigned
each for itself; other columns aren't used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tables import cut

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Components beyond this count as this: (2 * LIMIT)^2 * 64 stays below 2^63.
LIMIT = (1 << 27) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vector) of the vectors with dim components, none null or not finite."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("vector") == dim) & ~F.coalesce(odd, F.lit(True)))


def integers(vectors: pd.Series, dim: int, scale: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, dim), np.int64)
    return np.clip(np.floor(np.stack(vectors.to_numpy()) * float(scale)), -LIMIT, LIMIT).astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centroid (the lowest of equally near ones), and its squared distance."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distance = np.empty((len(points), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = points - centroid
        np.einsum("ij,ij->i", apart, apart, out=distance[:, k])
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(points)), cluster]


def _sums(frames: Iterator[pd.DataFrame], centroids: Broadcast, scale: int) -> Iterator[pd.DataFrame]:
    now = centroids.value
    sums, counts = np.zeros_like(now), np.zeros(len(now), np.int64)
    for frame in frames:
        points = integers(frame["vector"], now.shape[1], scale)
        cluster, _ = nearest(points, now)
        for k in np.unique(cluster):
            own = points[cluster == k]
            sums[k] += own.sum(axis=0)
            counts[k] += len(own)
    some = np.flatnonzero(counts)
    yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "sums": pd.Series(list(sums[some]), dtype=object)})


def _assign(frames: Iterator[pd.DataFrame], centroids: Broadcast, scale: int) -> Iterator[pd.DataFrame]:
    now = centroids.value
    for frame in frames:
        cluster, distance = nearest(integers(frame["vector"], now.shape[1], scale), now)
        yield pd.DataFrame({"id": frame["id"], "cluster": cluster.astype(np.int32), "distance": distance})


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    found = rows.select(F.sha2(named, 256).alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    return integers(pd.Series([np.array(r.vector) for r in found], dtype=object), dim, scale)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of each one's mean; a centroid without vectors stays."""
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    sums = rows.select("vector").mapInPandas(partial(_sums, centroids=shared, scale=scale), "cluster int, n long, sums array<long>")
    merged = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(dim)]).alias("sums"))
    after = centroids.copy()
    for r in merged.collect():
        after[r.cluster] = [int(x) // r.n for x in r.sums]
    shared.unpersist()
    return after


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid), one row per usable vector."""
    rows = usable(vectors, id_col, vector_col, dim)
    centroids = first_centroids(rows, k, seed, scale, dim)
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    assigned = cut(rows.mapInPandas(partial(_assign, centroids=shared, scale=scale), f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    sums = sums.select(F.col("cluster").alias("c"), F.col("own").try_cast("long").alias("cluster_inertia"))
    whole = assigned.agg(F.sum(F.col("distance").cast("decimal(20,0)")).try_cast("long").alias("inertia"))
    sums = sums.crossJoin(F.broadcast(whole))  # k rows with the one row of the whole
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids]).cast("array<string>")
    final = F.array(*[F.array(*map(F.lit, c.tolist())) for c in centroids]).cast("array<array<long>>")
    found = assigned.join(F.broadcast(sums), F.col("cluster") == F.col("c")).drop("c")
    return found.select("id", "cluster", "distance", "cluster_inertia", "inertia", F.get(digest, F.col("cluster")).alias("centroid_sha256"), F.get(final, F.col("cluster")).alias("centroid"))
