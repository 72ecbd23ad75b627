"""Phrase mining against plain counting, and the automaton against the definition of its states."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import collocations
from tests.llm.test_text_operators import LOWER


def brute(rows, longest=5, least=3, cover=100, top=2_000):
    """The result for rows (text, lang), by counting every phrase."""
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    candidates = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    inner = defaultdict(int)
    for g, a in candidates.items():
        for i in range(1, len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g) - 1:
                    inner[g[0], *g[i:j]] = max(inner[g[0], *g[i:j]], a)
    found = defaultdict(list)
    for (lang, *g), a in candidates.items():
        if 100 * inner[lang, *g] >= cover * a:
            continue
        cuts = []
        for k in range(1, len(g)):
            left, right = counts[lang, *g[:k]], counts[lang, *g[k:]]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(g).encode(), left, right))
    out = set()
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return out


def mined(spark, rows, **given):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, doc_id long, phrase string").repartition(3)
    found = [tuple(r) for r in collocations.mine_phrases(docs, **given).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made_up(rng, n, words=("the", "of", "AND", "big", "red", "apple", "É", "x")):
    ends = [" ", " ", "  ", "\t", ", ", ".", "\n", " "]
    return "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))


@pytest.mark.parametrize("shard_bytes", [collocations.SHARD_BYTES, 200, 1])
def test_phrases(spark, shard_bytes):
    rng = random.Random(1)
    rows = [(made_up(rng, rng.randrange(40)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" . , ", "xx"), ("alone", None), ("x" * 5_000 + " y", "en")] + [("one very common line of words here", "en")] * 50
    expected = brute(rows)
    assert len(expected) > 100 and mined(spark, rows, least=3, shard_bytes=shard_bytes) == expected


def test_top_ties_and_cover(spark):
    rows = [(f"w{k} v{k}", "en") for k in range(40) for _ in range(3)] + [("a b c d", "en"), ("a b c", "en"), ("a b", "en")] * 3
    assert mined(spark, rows, least=3, top=10) == brute(rows, top=10)
    for cover in (30, 60, 100):
        assert mined(spark, rows, least=3, cover=cover) == brute(rows, cover=cover)
    assert mined(spark, rows, least=3, longest=3) == brute(rows, longest=3)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)], "lang string, phrase string, a long")
    candidates = counts.where(F.col("phrase") == "a b").withColumn("n", F.lit(10**15))
    (r,) = collocations.lowest_cuts(candidates, counts).collect()
    assert r.score == 1000 * (big - 2) * 10**15 // (big * (big - 1)) and (r.l, r.r) == (big, big - 1)


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = made_up(rng, 3_000).encode() + b"z" * 300 + b" end"
    whole = [w for part in collocations.words_of(text) for w in part]
    for block in (1, 7, 64):
        monkeypatch.setattr(collocations, "BLOCK", block)
        assert [w for part in collocations.words_of(text) for w in part] == whole


def test_nothing_and_words_alone(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(None, None), ("word", "en"), ("...", "en")]) == set()


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", 1 << 3)
    rng = random.Random(3)
    rows = [(made_up(rng, 30), "en") for _ in range(60)]
    assert mined(spark, rows, least=3) == brute(rows)


def test_automaton():
    """States are classes of substrings with the same end places."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        words, follows = rng.integers(1, 5, 60), rng.random(60) < 0.85
        follows[0] = False
        depth = 5
        automaton = collocations.SuffixAutomaton(words, follows, depth)
        ends = defaultdict(set)
        for i in range(len(words)):
            for k in range(1, depth + 1):
                if i - k + 1 >= 0 and all(follows[i - k + 2 : i + 1]):
                    ends[tuple(words[i - k + 1 : i + 1].tolist())].add(i)
        for length in range(1, depth + 1):
            first, count, link = (x[length - 1] for x in (automaton.first, automaton.count, automaton.link))
            own = [tuple(words[i - length + 1 : i + 1].tolist()) for i in first.tolist()]
            assert len(set(own)) == len(own) and {g: c for g, c in zip(own, count.tolist(), strict=True)} == {g: len(e) for g, e in ends.items() if len(g) == length}
            assert all(min(ends[g]) == i for g, i in zip(own, first.tolist(), strict=True))
            if length > 1:
                up = automaton.first[length - 2]
                assert [tuple(words[i - length + 2 : i + 1].tolist()) for i in up[link].tolist()] == [g[1:] for g in own]
            longest = automaton.longest(length).tolist()
            assert longest == [not any(ends[h] == ends[g] for h in ends if len(h) == length + 1 and h[1:] == g) for g in own]
    empty = collocations.SuffixAutomaton(np.zeros(0, np.int64), np.zeros(0, bool), 3)
    assert [len(x) for x in empty.first] == [0, 0, 0]


def test_keys_are_sparks(spark):
    rows = [("en", "word"), ("und", "naïve"), ("de", "x" * 100), ("", "")]
    found = spark.createDataFrame(rows, "lang string, word string").select("lang", "word", F.xxhash64("lang", "word").alias("key")).collect()
    for r in found:
        assert collocations.word_keys(r.lang, [r.word.encode()]).view(np.int64)[0] == r.key
    assert xxhash.xxh64_intdigest(b"") and pa.array([]).type == pa.null()
