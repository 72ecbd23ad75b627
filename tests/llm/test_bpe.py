"""Byte-level BPE against the tiktoken library, with edits and odd rows."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tessella.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.vocabulary(byte_bpe.ranks_path(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(own, *texts):
    found = [[] for _ in texts]
    for k, ids in own.encode(list(texts)):
        found[k] += ids.tolist()
    return found


def made_up(rng, most=30):
    return "".join(rng.choice(["'", " ", "  ", "\n", "re", "l", "ll", "s", "the", "ing", "é", "中文", "1", "23", "!", "...", "\t", "\x1c", " ", "A", "zq", "🙂", "<|endoftext|>"]) for _ in range(rng.randrange(most)))


def test_texts(own, library):
    rng = random.Random(1)
    texts = ["", " ", "a" * 5_000, "  \n " * 300, "ab" * 3_000, *(made_up(rng) for _ in range(1_500))]
    assert ids_of(own, *texts) == [library.encode_ordinary(t) for t in texts]


def test_every_kind_of_character(own, library):
    for low in range(0, 0x30000, 0x1000):
        text = "".join(f"a{c}1{c}{c} {c}!{c} " for c in map(chr, range(low, low + 0x1000, 3)) if not "\ud800" <= c <= "\udfff")
        assert ids_of(own, text) == [library.encode_ordinary(text)], hex(low)


def test_long_texts_and_forgotten_matches(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "WHOLE", 50)
    monkeypatch.setattr(byte_bpe, "MATCHES", 7)
    monkeypatch.setattr(byte_bpe, "PAIRS", 30)
    rng = random.Random(2)
    texts = [made_up(rng, 120) for _ in range(200)]
    assert ids_of(own, *texts) == [library.encode_ordinary(t) for t in texts]


def test_compatible_is_what_merging_says(own):
    rng = random.Random(3)
    tokens = range(len(own.tokens))
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens[: rng.choice([300, 3_000, 50_000])])
        assert own._compatible(a, b) == (own.merged(own.tokens[a] + own.tokens[b])[0] == [own.tokens[a], own.tokens[b]])


def test_ranks_out_of_order():
    """A token with a lower rank than its parts, and one that merges don't make."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"abc": 0, b"ab": 50, b"cd": 40, b"xyz": 1, b"abcab": 3}
    own = byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdxyz ") for _ in range(12)) for _ in range(3_000)]
    assert ids_of(own, *texts) == [library.encode_ordinary(t) for t in texts]


def test_edits(own, library):
    rng = random.Random(5)
    for _ in range(300):
        encoded = byte_bpe.EncodedText(own, made_up(rng))
        for _ in range(4):
            start = rng.randrange(len(encoded.text) + 1)
            stop = rng.randrange(start, len(encoded.text) + 1)
            by = rng.choice(["", "e", "ll", " ", "re", "'", "  x"])
            expected = encoded.text[:start] + by + encoded.text[stop:]
            encoded.replace(start, stop, by)
            assert encoded.text == expected and encoded.ids() == library.encode_ordinary(expected)


def test_an_edit_looks_only_near_itself(own):
    encoded = byte_bpe.EncodedText(own, "some words that stay " * 2_000)
    before = encoded.found
    encoded.append("hypothe")
    encoded.append("tical")
    encoded.replace(20_000, 20_003, "new")
    assert encoded.found - before < 80


def test_documents(spark, library):
    texts = [None, "", "plain words", "x " * 40_000, "plain words", "naïve <|endoftext|> 中"]
    docs = spark.createDataFrame([(k if k else None, t, 1, b"clash") for k, t in enumerate(texts)], "doc_id long, text string, id int, ids binary")
    found = {r.id: r for r in byte_bpe.encode_documents(docs).collect()}
    assert found.keys() == {None, 1, 2, 3, 4, 5}
    for k, text in enumerate(texts):
        ids, r = library.encode_ordinary(text or ""), found[k or None]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert {r.id: bytes(r.bytes).decode() for r in decoded} == {k or None: t or "" for k, t in enumerate(texts)}
    assert byte_bpe.encode_documents(docs.limit(0)).count() == 0
    assert all(r.ids is None for r in byte_bpe.encode_documents(docs, with_ids=False).collect())


def test_edited_documents(spark, library):
    rows = [(1, "one two", [(7, 7, " three"), (0, 3, "eight")]), (2, None, [(5, 9, "late")]), (3, "same", None), (4, "x", [(None, None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: int, stop: int, text: string>>")
    found = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode_edited(docs).collect()}
    assert found == {k: library.encode_ordinary(t) for k, t in ((1, "eight two three"), (2, "late"), (3, "same"), (4, "x"))}
