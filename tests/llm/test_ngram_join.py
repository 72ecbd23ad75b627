"""The n-gram Jaccard join: sets, prefixes, trees and components against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import ngram_join, prefix_tree, shingles
from tessella.llm.measure import Measure
from tessella.llm.prefix_tree import PrefixTree, spanning_links
from tessella.llm.shingles import sets_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MEASURES = [Measure(), Measure(5, 80, 100)]


def brute_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def linked(x, y, measure):
    return bool(x) and bool(y) and measure.den * len(x & y) >= measure.num * len(x | y)


def brute_components(sets, measure):
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if root[i] != root[j] and linked(sets[i], sets[j], measure):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def joined(n, links, root=None):
    root = list(range(n)) if root is None else list(root)
    for i, j in links:
        a, b = root[i], root[j]
        assert a != b, "a link that joins nothing"
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def families(rng, families=8, copies=12, sizes=(1, 8, 30, 150)):
    bases = [rng.sample(range(10_000), rng.choice(sizes)) for _ in range(families)]
    sets = [set(b) ^ set(rng.sample(range(10_000), rng.randrange(len(b) // 6 + 1))) for b in bases for _ in range(copies)]
    return [set(x) for x in {frozenset(s) for s in sets if s}]


@pytest.mark.parametrize("span", [5, 40, 1 << 20])
def test_sets(monkeypatch, span):
    monkeypatch.setattr(shingles, "SPAN", span)
    rng = random.Random(span)
    for _ in range(60):
        n = rng.choice([1, 3, 5])
        texts = [rng.choice([None, "", " ", "\t\n", "a", "A  b c", "É b c d\x1f e", " ".join(rng.choice("abcdE") for _ in range(rng.randrange(12)))]) for _ in range(rng.randrange(1, 9))]
        found = list(sets_of(pa.array(["before", *texts])[1:], n))
        expected = [brute_set(t, n) for t in texts]
        assert [len(x) for x in found] == [len(x) for x in expected]
        for i, j in combinations(range(len(texts)), 2):
            assert len(np.intersect1d(found[i], found[j])) == len(expected[i] & expected[j])
        assert all((x == shingles.shingles(t, n)).all() for x, t in zip(found, texts, strict=True))


@pytest.mark.parametrize("measure", MEASURES)
def test_linked_sets_share_a_prefix_element(measure):
    """In the join's order, whatever the counts, and within what a set gives out."""
    rng, met = random.Random(3), 0
    for _ in range(2000):
        size = rng.choice([2, 5, 6, 9, 12, 20, 40, 300])
        x = {rng.getrandbits(63) for _ in range(size)}
        y = set(x)
        for _ in range(rng.randrange(size // 4 + 1)):
            y.remove(rng.choice(sorted(y))) if rng.random() < 0.5 else y.add(rng.getrandbits(63))
        if not linked(x, y, measure):
            continue
        met += 1
        count, prefixes = {e: rng.randrange(5) for e in x | y}, []
        for s in (x, y):
            inside, first = ngram_join.first_elements(np.array(sorted(s), np.uint64), measure)
            first = [int(e) for e in first]
            order = sorted(first[:inside], key=lambda e: (count[e], e)) + first[inside:]
            assert len(order) >= measure.prefix(len(s))
            prefixes.append(set(order[: measure.prefix(len(s))]))
        assert prefixes[0] & prefixes[1]
    assert met > 300


@pytest.mark.parametrize("segment", [1, 5, 32])
@pytest.mark.parametrize("measure", MEASURES)
def test_tree_finds_all_linked_sets(monkeypatch, measure, segment):
    monkeypatch.setattr(prefix_tree, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(5):
        sets = families(rng)
        tree = PrefixTree([np.array(sorted(s), np.uint64) for s in sets], measure)
        group = np.array([rng.randrange(5) for _ in sets])
        for k, s in enumerate(sets):
            assert sorted(tree.linked(k, np.arange(len(sets)))) == [j for j, t in enumerate(sets) if j != k and linked(s, t, measure)]
            assert sorted(tree.linked(k, group)) == [j for j, t in enumerate(sets) if group[j] != group[k] and linked(s, t, measure)]


def test_a_set_that_begins_another_is_found():
    measure = Measure(3, 50, 100)
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 3, 4], [1, 2], [9])]
    assert sorted(PrefixTree(sets, measure).linked(0, np.arange(4))) == [1, 2]
    assert PrefixTree(sets[3:], measure).linked(0, np.arange(1)).size == 0


@pytest.mark.parametrize("measure", MEASURES)
def test_spanning_links_join_what_links_connect(measure):
    rng = random.Random(11)
    for _ in range(8):
        sets = families(rng, copies=15)
        arrays, n = [np.array(sorted(s), np.uint64) for s in sets], len(sets)
        assert joined(n, spanning_links(arrays, measure, range(n), 0, range(n))) == brute_components(sets, measure)
        # some sets are known to be connected with one, and only the others are probes
        true, hub = brute_components(sets, measure), rng.randrange(n)
        known = [k for k in range(n) if k == hub or true[k] == true[hub] and rng.random() < 0.7]
        group = [min(known) if k in known else k for k in range(n)]
        for held in (known[0], None):
            links = spanning_links(arrays, measure, group, held, [k for k in range(n) if k not in known])
            assert joined(n, links, group) == true


@pytest.mark.parametrize(("measure", "sets", "grams"), [(MEASURES[0], 1_000, 200_000), (MEASURES[1], 1_000, 200_000), (MEASURES[0], 6, 200_000), (MEASURES[1], 1_000, 700)])
def test_components(spark, monkeypatch, tmp_path, measure, sets, grams):
    """With whole bundles, and with bundles of several blocks, of few sets or of few n-grams."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_join, "BLOCK", grams)
    rng = random.Random(measure.n)
    passage = [f"p{k}" for k in range(60)]
    texts = [None, "", "a", "A", "a b", "one two three", "one two three"]
    for _ in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 15, 40, 120, 400]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):  # up to and beyond the threshold: near misses of each other, too
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    roots = brute_components([brute_set(t, measure.n) for t in texts], measure)
    spark.createDataFrame([(k + 10, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, key string").withColumn("nth", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs")
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(rows, measure=measure).collect()}
    assert found == {k + 10: (len(brute_set(t, measure.n)), roots[k] + 10) for k, t in enumerate(texts)}
    kept = ngram_join.drop_near_copies(rows, measure=measure)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r + 10 for r in roots})


def test_edges(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "A B\tC D"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r)[1:4] for r in ngram_join.near_components(rows).collect()), key=repr) == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None)], key=repr)
    assert ngram_join.drop_near_copies(rows).count() == 2
    assert ngram_join.near_components(rows.limit(0)).count() == 0


def test_texts_by_row_numbers(spark, monkeypatch, tmp_path):
    """With more wanted rows than are broadcast, bitmaps of row numbers go before the join: the same components."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    base = [rng.choices(words, k=30) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(base)[: rng.choice([30, 30, 29, 28])])) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    expected = sorted(map(tuple, ngram_join.near_components(df).select("id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ngram_join.near_components(df).select("id", "n_shingles", "component_id").collect())) == expected
