"""Centroid clustering against plain loops over Python integers."""

import hashlib
import math
import random
from collections import defaultdict

from tessella.llm import clustering

NAN, INF = float("nan"), float("inf")


def brute(vectors, k, rounds, dim, scale, seed):
    kept = [(i, [max(-clustering.LIMIT, min(clustering.LIMIT, math.floor(x * scale))) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)[1]].append(v)
        centroids = [[sum(column) // len(own[n]) for column in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centroids)]
    found = [(i, *place(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n], centroids[n]) for i, d, n in found), key=repr)


def check(spark, vectors, kind="float", **given):
    options = {"k": 4, "rounds": 3, "dim": 3, "scale": 64, "seed": 1} | given
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in vectors], f"vec_id long, embedding array<{kind}>, cluster int, vector string").repartition(3)
    found = clustering.cluster_vectors(df, **options)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(vectors, **options)


def test_rounds(spark):
    rng = random.Random(1)
    check(spark, [(k, [rng.randrange(-40, 40) / 16 for _ in range(3)]) for k in range(300)])


def test_odd_vectors(spark):
    odd = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, 2.0, 3.0, 4.0]), (54, [1.0, None, 0.0]), (55, [NAN, 0.0, 0.0]), (56, [0.0, -INF, 0.0]), (None, [0.5, 0.5, 0.5])]
    check(spark, odd + [(k, [float(k % 5), -0.3, 0.01]) for k in range(20)] + [(3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0])])


def test_ties_copies_and_empty_centroids(spark):
    check(spark, [(k, [1.0, 1.0, 1.0]) for k in range(30)] + [(40, [0.0, 1.0, 1.0]), (41, [2.0, 1.0, 1.0])], k=6)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], k=16)
    check(spark, [], k=16)
    check(spark, [(1, None)], k=16)


def test_large_components(spark):
    check(spark, [(k, [x, -x, 1.0]) for k, x in enumerate([1e30, 2e6, 2_097_151.9, -3e300, 5.0, 7.0])], kind="double", dim=3)


def test_no_rounds(spark):
    check(spark, [(k, [float(k), 0.0, 0.0]) for k in range(9)], rounds=0)
