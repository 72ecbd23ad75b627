"""Exact dedup, source mixing, packing and embedding near-dedup against brute force, with edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import embedding_dedup, exact_dedup, mixing, packing
from tessella.llm.components import components


# ---- exact dedup

TEXTS = [None, "", "a", "a ", "A", "a", "b" * 50_000, "b" * 50_000, "é", "é", "only"]


@pytest.mark.parametrize(("shard_rows", "bits"), [(exact_dedup.SHARD_ROWS, exact_dedup.FILTER_BITS), (50, 512), (60, 1)])
def test_exact_dedup(spark, monkeypatch, shard_rows, bits):
    """In one shard, in several with full filters, and with filters that let everything pass."""
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a"), (50, "tie"), (50, "tie"), (None, "n"), (None, "n")] + [(100 + k, rng.choice(["hot", f"t{k}"])) for k in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string").withColumn("row", F.lit(1))
    found = exact_dedup.mark_copies(df).collect()
    groups = defaultdict(list)
    for id_, t in rows:
        groups[t or ""].append(-1 if id_ is None else id_)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    by_digest = {digest(t): own for t, own in groups.items()}
    assert Counter((r.id, r.digest) for r in found) == Counter((id_, digest(t)) for id_, t in rows)
    for r in found:
        own = by_digest[r.digest]
        assert (r.group_size, -1 if r.keep_id is None else r.keep_id) == (len(own), max(own))
    assert Counter(r.digest for r in found if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(df.limit(0)).count() == 0


def test_shards_come_one_after_the_other(spark, monkeypatch):
    """Twenty shards: the plan of the result has no filter of any of them, and the result is that of one."""
    rows = [(k, f"t{k % 700}") for k in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, exact_dedup.mark_copies(df).select("id", "keep_id", "group_size", "kept").collect()))
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 4_096)
    many = exact_dedup.mark_copies(df)
    assert sorted(map(tuple, many.select("id", "keep_id", "group_size", "kept").collect())) == one
    plan = many._jdf.queryExecution().toString()
    assert "bitmap" not in plan and plan.count("BroadcastExchange") <= 4


# ---- mixing

def brute_targets(sizes):
    """source: target, by capping and sharing again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: 2.0 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return capped | share
        capped |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    docs = [(k, "w " * rng.choice([0, 1, 5, 40]) + rng.choice(["", "\t\n"]), rng.choice(["hot"] * 6 + ["b", "c", "é", None, "z"]), "clash") for k in range(400)]
    docs += [(None, None, "b", ""), (3, "x y", "only", ""), (3, "x y", "only", ""), (9, "", "nothing", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, target string").withColumn("part", F.lit(1))
    found = mixing.mix(df).collect()
    assert len(found) == len(docs)
    sizes = Counter({s: 0 for *_, s, _ in docs})
    for _, t, s, _ in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = brute_targets(sizes)
    taken = Counter()
    for r in found:
        s = r.row.source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or "")) and r.source_size == sizes[s]
        assert math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 2, s
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((str(r.id), r.size, r.taken) for r in again) == sorted((str(r.id), r.size, r.taken) for r in found)
    assert mixing.repeat_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


# ---- packing

@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(spark, tokenizer):
    rng = random.Random(6)
    words = ["The", "don't", "naïve", "x2y", "über-long", "<|endoftext|>", "…", "日本", "U.S.", "ﬁ", "İstanbul", "á", " ", "tab\tbed"]
    docs = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\r\n "]) for _ in range(rng.choice([0, 1, 7, 300, 3000]))), "clash") for k in range(60)]
    docs += [(None, None, ""), (7, "same id", ""), (1000, "", ""), (1001, "long " * 20_000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").withColumn("sequence_id", F.lit(1))
    rows = packing.pack_documents(df, with_ids=True).collect()
    expected = Counter()
    for id_, t, _ in docs:
        expected[id_, struct.pack(f"<{len(ids)}I", *ids) if (ids := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) else b""] += 1
    whole = {(id_, ids) for id_, ids in expected}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length <= 4096
        assert any(id_ == r.id and len(ids) == 4 * r.doc_tokens and ids[4 * r.start :][: 4 * r.length] == bytes(r.ids) for id_, ids in whole)
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in expected.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and {r.sequence_tokens for r in own} == {at}
        assert {r.padded_tokens for r in own} == {at if at & (at - 1) == 0 else 4096}
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_in_several_shards(spark):
    """Sequences of different shards have different ids; each is gapless, and no piece is lost."""
    docs = spark.createDataFrame([(k, f"word{k} " * (k % 37)) for k in range(200)], "doc_id long, text string")
    pieces = packing.cut_documents(docs)
    rows = packing.pack(pieces, shard_pieces=30).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 3 and Counter((r.id, r.start, r.length) for r in rows) == Counter((r.id, r.start, r.length) for r in pieces.collect())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_mixing_many_sources_and_long_texts(spark, monkeypatch):
    """Budgets joined by shuffling, a source whose only text is very long, and one without words next to the null source."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    docs = [(k, "w " * (k % 9), f"s{k % 40}") for k in range(400)] + [(900, "long " * 100_000, "z"), (901, " ", "empty"), (902, "a b", None)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes = Counter({s: 0 for *_, s in docs})
    for _, t, s in docs:
        sizes[s] += len(t.split())
    targets, taken = brute_targets(sizes), Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and math.isclose(r.target, targets[r.row.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.row.source] += r.taken
    assert len(found) == len(docs) and all(abs(taken[s] - t) <= 2 for s, t in targets.items())


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(7)
    lengths = np.array([rng.randrange(1, 65) for _ in range(500)])
    sequence, offset, tokens = packing.best_fit(lengths, 64)
    opened = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [c for c in opened if c >= lengths[k]]
        capacity = min(fits, default=64)
        if fits:
            opened.remove(capacity)
        assert offset[k] == 64 - capacity
        opened.append(capacity - lengths[k])
    assert len(tokens) == len(opened) and tokens.sum() == lengths.sum() and tokens.max() <= 64


# ---- embedding near-duplicates

def brute_links(rows, threshold):
    usable = {k: np.array(v, float) for k, (_, label, v) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = defaultdict(set)
    for i, x in usable.items():
        for j, y in usable.items():
            if i < j and rows[i][1] == rows[j][1] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root[k] = min(rows[j][0] for j in seen)
    return links, root


@pytest.mark.parametrize("cell, block", [(8192, 8192), (8192, 16), (30, 8)])
def test_embedding_near_duplicates(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(140):
        if k % 3 and rows[-1][2]:
            v = (np.array(rows[-1][2]) + rng.normal(0, rng.choice([0.0, 0.05, 0.3]), 16)) * rng.choice([1.0, 3.0])
        else:
            v = rng.normal(size=16)
        rows.append((k, int(rng.integers(0, 2)) if k % 9 else rows[-1][1] if rows else 0, [float(np.float32(x)) for x in v]))
    rows += [(200, None, [1.0] * 16), (201, 1, None), (202, 1, []), (203, 1, [0.0] * 16), (204, 1, [1.0, None] * 8), (205, 1, [float("nan")] * 16), (206, 0, [float("inf")] * 16), (207, 1, [1.0, 0.0]), (208, 1, [2.0, 0.0]), (209, 1, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, n_links string").withColumn("key", F.lit(1))
    found = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    links, root = brute_links(rows, embedding_dedup.THRESHOLD)
    expected = {r[0]: (len(links[k]), root[k]) for k, r in enumerate(rows)}
    if cell >= 8192:
        assert found == expected
    else:  # many small tables: recall is near one, and nothing below the threshold is linked
        assert all(found[k][0] <= expected[k][0] for k in expected)
        assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in expected.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_null_ids_of_vectors(spark):
    """A null id is larger than any other, and a row of its own."""
    rows = [(None, 1, [1.0, 0.0]), (5, 1, [1.0, 0.001]), (None, 1, [0.0, 1.0]), (7, 2, [1.0, 0.0])]
    found = Counter((r.id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert found == Counter([(None, 1, 5), (5, 1, 5), (None, 0, None), (7, 0, 7)])


def clustered(rng, n, dim=32):
    """Vectors of which most are near copies of others, on both sides of the threshold."""
    heads = rng.normal(size=(n // 10, dim))
    return heads[rng.integers(0, len(heads), n)] + rng.normal(0, 1, (n, dim)) * rng.choice([0.08, 0.13, 0.2], (n, 1))


@pytest.mark.parametrize("dim", [2, 12, 64])
def test_collision_counting_misses_next_to_nothing(dim):
    rng = np.random.default_rng(dim)
    units = embedding_dedup.units(clustered(rng, 1_500, dim))
    found = np.zeros((1_500, 900), bool)
    for i, j in embedding_dedup.linked(units, units[600:], 0.98):
        assert not found[i, j].any()
        found[i, j] = True
    true = units @ units[600:].T
    assert not (found & (true < 0.98 - 1e-12)).any() and (found & (true >= 0.98)).sum() >= 0.999 * (true >= 0.98).sum() > 0


def test_embedding_recall_over_many_cells(spark, monkeypatch):
    """A label of 20 times the cell's size: the links of the vectors whose id is divisible by 20, and their components."""
    monkeypatch.setattr(embedding_dedup, "CELL", 200)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    vectors = clustered(np.random.default_rng(4), 4_000).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    found = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    units = embedding_dedup.units(vectors)
    true = (units[::20] @ units.T >= 0.98).sum(axis=1) - 1
    of_queries = np.array([found[k] for k in range(0, 4_000, 20)])
    assert (of_queries <= true).all() and of_queries.sum() >= 0.995 * true.sum() > 1_000


def test_components(spark):
    rng = random.Random(8)
    for n in (0, 1, 40, 150):
        pairs = [(f"n{rng.randrange(100):03}", f"n{rng.randrange(100):03}") for _ in range(n)] + [("chain%03d" % k, "chain%03d" % (k + 1)) for k in range(30 if n else 0)] + [(None, "x")] * bool(n)
        found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
        root = {x: x for p in pairs for x in p if x is not None and None not in p and p[0] != p[1]}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                if a in root and b in root and a is not None and b is not None and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        assert found == root


def test_exact_embedding_links(spark, monkeypatch):
    """exact=True: a label of several blocks, windows that nothing can miss; no link is lost, even with a cell that would be small."""
    monkeypatch.setattr(embedding_dedup, "CELL", 50)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    vectors = clustered(np.random.default_rng(8), 300, 16)
    df = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    found = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, exact=True).collect()}
    units = embedding_dedup.units(vectors)
    expected = ((units @ units.T >= embedding_dedup.THRESHOLD).sum(axis=1) - 1).tolist()
    assert [found[k] for k in range(len(vectors))] == expected and sum(expected) > 0
    assert embedding_dedup.window(16, 0.98, True)[0] == pytest.approx(0.2) and embedding_dedup.tables(10**6, 0.98, None) == (0, 1)


def test_sieve_leaves_few_pairs():
    """Of random vectors, windows along the first directions leave under 5% of the pairs to be counted."""
    units = embedding_dedup.units(np.random.default_rng(9).standard_normal((3_000, 64)))
    at = units @ embedding_dedup.directions(64)[:, : embedding_dedup.SIEVE]
    wide, _, _ = embedding_dedup.window(64, 0.98)
    near = np.ones((3_000, 3_000), bool)
    for k in range(embedding_dedup.SIEVE):
        near &= np.abs(at[:, None, k] - at[None, :, k]) <= wide
    assert near.mean() < 0.05


def test_quality_of_texts(spark):
    texts = ["plain words of a usual length make up this text, and there are some forty of them or so in all, which is " * 2, "a b c d", "%%% $$$ *** &&& ### @@@ ^^^ ~~~ || <>", None, "", "one\ntwo\nthree\nfour"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    found = {r.k: r.q for r in rows.select("k", mixing.quality(F.col("t"), mixing.count_words(F.col("t"))).alias("q")).collect()}
    assert all(0.25**2 <= q <= 1 for q in found.values()) and found[0] == 1 and found[0] > max(v for k, v in found.items() if k) and found[1] < 0.1
