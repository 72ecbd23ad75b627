"""Phrase collocations by suffix automata per shard.

1. *Shards.*  Texts become numbers of words where they lie, a language at a time, in shards of about
   `SHARD_BYTES` of text (never less than a text); a shard holds its words and the sequence of their numbers,
   0 between pieces, packed.  Shards are written once, and all later passes read them.
2. *Filters.*  Words, then pairs of words that can be frequent, then longer runs of such pairs are counted by a hash
   of some bits more than there are words.  A shard's counts go out as sorted blocks, a row for each part of the hashes, and
   each part is summed by itself; hashes below the least count can't belong to a candidate.  This only filters: two phrases under one
   hash let more through, never less.
3. *Automata.*  Each shard builds the generalised suffix automaton of its runs of pairs that can be frequent, bounded to the
   longest phrase, with the number of end places of each state, and enumerates the substrings with their
   counts: by hash for the last filter, and then, those that pass, by text.
4. *Counts.*  They are summed by language and phrase as text, so they are exact.
5. *Scores.*  A candidate is joined with the counts of both parts of each of its cuts; hot parts (a common
   word begins very many phrases) are broadcast, the others shuffle.  Products are decimals of 38 digits.
6. *Subsumption.*  The suffix link of a candidate leads to the candidate without its first word, and the
   link in the automaton of the reversed texts to the one without its last.  A candidate is inside a longer
   one that is about as frequent exactly if such a link from one word more leads to it, since counts only
   fall along a chain of extensions.

Filters go to the tasks as bitmaps of at most 32 MB; with more in them, more passes and nothing else changes.

Defined cases: a null or empty text has no words; a null language is `und`; rows count each for itself,
whatever their ids; of candidates with equal score and count the smaller phrase in bytes comes first; other
columns aren't used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.tables import BITMAP_BITS, bitmaps, cut, join_groups, written

SHARD_BYTES = 1 << 24
#: Entries of a part of the hashes that one task sums, about; bits of a hash beyond those that count the words.
PART, SPARE_BITS = 4_000_000, 4
#: Bytes of a text that are split into words in one go.
BLOCK = 1 << 22
LONGEST, LEAST, TOP = 5, 100, 2_000
#: A candidate is dropped if a longer one around it has so many hundredths of its count.
COVER = 100
#: Groups that a language's candidates are ranked in before they are ranked together.
SALTS = 64
#: Languages whose sizes are broadcast; more are joined by shuffling.
BROADCAST_LANGS = 20_000

#: A-Z become small, the ends of pieces a byte that UTF-8 doesn't have, a tab a space.
END = b"\xff"
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + END * 10 + b" ")
#: Odd number that makes a pair's hash from those of its words.
MIX = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Numbers of words in the order of their coming; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of text, END between pieces, some at a time."""
    text = text.translate(_BYTES)
    at = 0
    while at < len(text):
        ends = [e for e in (text.find(b" ", at + BLOCK), text.find(END, at + BLOCK)) if e >= 0] if at + BLOCK < len(text) else []
        end = min(ends, default=len(text))
        yield text[at:end].replace(END, b" \xff ").split()
        at = end


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    numbers: dict[str, Numbers] = {}
    places: dict[str, list[np.ndarray]] = {}
    held = 0

    def shards() -> Iterator[pa.RecordBatch]:
        for lang, own in numbers.items():
            ids = np.concatenate(places[lang])
            packed = [b"\n".join(list(own)[1:]), ids.tobytes()]  # words have no line ends
            columns = [pa.array([lang]), pa.array([int(np.count_nonzero(ids))], pa.int64())]
            columns += [pa.array([len(x)], pa.int64()) for x in packed] + [pa.array([pa.compress(x, "zstd", asbytes=True)], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "words_size", "places_size", "words", "places"])
        numbers.clear()
        places.clear()

    end = np.zeros(1, np.int32)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            own, found = numbers.setdefault(lang, Numbers()), places.setdefault(lang, [])
            for words in words_of(text):
                found.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
            found.append(end)
            held += len(text)
            if held >= shard_bytes:
                yield from shards()
                held = 0
    yield from shards()


def shards_of(docs: DataFrame, text_col: str, lang_col: str, shard_bytes: int) -> DataFrame:
    """(lang, n, words_size, places_size, words, places): how many words a shard has, the different ones (a line each) and the sequence of their numbers (from 1, as 32-bit integers; 0 between pieces), both compressed."""
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("binary").alias("text"))
    return written(texts.mapInArrow(partial(_shards, shard_bytes=shard_bytes), "lang string, n long, words_size long, places_size long, words binary, places binary"))


class SuffixAutomaton:
    """The generalised suffix automaton of many runs of words, bounded to substrings of `depth` words.

    words: numbers of words; follows[i]: whether word i is in one run with the word before it.  The automaton
    is built from its link tree, which is the tree of the runs' contexts read backwards: level by level, the
    substrings that end at a place are refined by one more word to the left, as one sort of numbers.  For each level
    (a length) there are `first` (a place where the substring ends), `count` (of its end places) and `link` (the
    substring without its first word, one level up).  Substrings along links with equal counts have the same end
    places, and so are one state: `longest` tells which are the longest of theirs."""

    def __init__(self, words: np.ndarray, follows: np.ndarray, depth: int):
        self.first: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.link: list[np.ndarray] = []
        at = np.arange(len(words))
        node = np.asarray(words, np.int64)
        width = int(node.max(initial=0)) + 1
        reaches = np.ones(len(words), bool)  # whether a substring of this length ends here
        for length in range(1, depth + 1):
            if length > 1:
                reaches = follows & np.append(False, reaches[:-1])
                kept = reaches[at]
                at, parent = at[kept], node[kept]
                node = parent * width + words[at - length + 1]
            found, first, node, count = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
            self.first.append(at[first])
            self.count.append(count)
            self.link.append(parent[first] if length > 1 else np.zeros(len(found), np.int64))

    def longest(self, length: int) -> np.ndarray:
        """Of the substrings of this length, which are the longest of their states (within the depth)."""
        if length >= len(self.first):
            return np.ones(len(self.first[length - 1]), bool)
        most = np.zeros(len(self.first[length - 1]), np.int64)
        np.maximum.at(most, self.link[length], self.count[length])
        return most < self.count[length - 1]


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Filter:
    """Which hashes of `bits` bits can be among those that the bitmap was made of."""

    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.mask, self.shift = bitmap, np.uint64(8 * len(bitmap) - 1), np.uint64(64 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift) & self.mask
        return (self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(slots: DataFrame, bits: int) -> Broadcast:
    """A Filter of the rows (slot; written down), 16 bits each as long as that is at most BITMAP_BITS."""
    size = min(BITMAP_BITS, 1 << max(15, (16 * slots.count()).bit_length()))
    found = bitmaps(slots.select(F.pmod("slot", F.lit(size)).alias("slot")).distinct())
    bitmap = np.zeros(size // 8, np.uint8)
    for r in found.toLocalIterator():  # at most 32 MB
        begin = (r.bucket - 1) * len(r.bitmap)
        own = bitmap[begin : begin + len(r.bitmap)]
        own[:] = np.frombuffer(r.bitmap, np.uint8)[: len(own)]
    return slots.sparkSession.sparkContext.broadcast(Filter(bitmap, bits))


class Shard:
    """A shard as it is read: its words, their hashes (0 for the end of a piece), and the sequence of their numbers."""

    def __init__(self, lang: str, words: bytes, places: bytes):
        self.lang = lang
        names = words.split(b"\n") if words else []
        self.names = pa.array(names, pa.binary())
        self.keys = np.append(np.zeros(1, np.uint64), word_keys(lang, names))
        self.places = np.frombuffer(places, np.int32)

    def follows(self, frequent: Filter) -> np.ndarray:
        """Whether a place and the one before it hold words that can be frequent."""
        known = frequent(self.keys)
        known[0] = False
        held = known[self.places]
        return held & np.append(False, held[:-1])

    def substrings(self, filters: list[Filter], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 2 on: hashes, counts, places where the phrases end, and the words that the places are of; of phrases whose words and pairs can be frequent."""
        follows, places = self.follows(filters[0]), self.places
        if len(filters) > 1:
            end = np.flatnonzero(follows)
            follows[end] = filters[1](self.keys[places[end - 1]] * MIX + self.keys[places[end]])
        some = follows.copy()  # places in a run of two words or more
        some[:-1] |= follows[1:]
        places = places[some]
        automaton = SuffixAutomaton(places, follows[some], longest)
        for length in range(2, longest + 1):
            last = automaton.first[length - 1]
            key = self.keys[places[last - length + 1]]
            for back in range(length - 2, -1, -1):
                key = key * MIX + self.keys[places[last - back]]
            yield key, automaton.count[length - 1], last, places


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            yield Shard(lang, *(pa.decompress(batch.column(name)[k].as_buffer(), batch.column(f"{name}_size")[k].as_py(), "zstd", asbytes=True) for name in ("words", "places")))


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit integers, compressed byte by byte place."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _counts(batches: Iterator[pa.RecordBatch], filters: list[Broadcast], longest: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of each shard, the counts of words (without filters), of pairs (with that of words) or of longer phrases (with that of pairs too): rows (part, n, slots, counts)."""
    own = [f.value for f in filters]
    for shard in _read(batches):
        if not own:
            found = [(shard.keys[1:], np.bincount(shard.places, minlength=len(shard.keys))[1:])]
        elif len(own) == 1:
            found = [x[:2] for x in shard.substrings(own, 2)]
        else:
            found = [x[:2] for x in shard.substrings(own, longest)][1:]
        slots = np.concatenate([np.zeros(0, np.uint64), *(key >> np.uint64(64 - bits) for key, _ in found)])
        counts = np.concatenate([np.zeros(0, np.int64), *(count for _, count in found)])
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        width = -(-(1 << bits) // parts)
        ends = np.searchsorted(slots, np.arange(1, parts, dtype=np.uint64) * np.uint64(width))
        rows = [(p, len(x), _planes(np.diff(x, prepend=np.uint64(0))), _planes(c)) for p, (x, c) in enumerate(zip(np.split(slots, ends), np.split(counts, ends), strict=True)) if len(x)]
        for begin in range(0, len(rows), 1_000):
            columns = zip(*rows[begin : begin + 1_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "slots", "counts"])


def can_be_frequent(shards: DataFrame, filters: list[Broadcast], least: int, longest: int, words: int) -> Broadcast:
    """A Filter of what _counts counts: of the hashes that come `least` times or more in all shards."""
    bits = min(62, max(16, words.bit_length() + SPARE_BITS))
    parts = max(1, -(-words // PART))
    blocks = shards.mapInArrow(partial(_counts, filters=filters, longest=longest, bits=bits, parts=parts), "part long, n long, slots binary, counts binary")

    def summed(table: pa.Table) -> pa.Table:
        rows = [table.column(c).to_pylist() for c in ("n", "slots", "counts")]
        slots = np.concatenate([np.cumsum(_numbers(s, n), dtype=np.uint64) for n, s, _ in zip(*rows, strict=True)])
        counts = np.concatenate([_numbers(c, n) for n, _, c in zip(*rows, strict=True)]).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        begins = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
        return pa.table({"slot": pa.array(slots[begins][np.add.reduceat(counts, begins) >= least].astype(np.int64))})

    return filter_of(cut(blocks.groupBy("part").applyInArrow(summed, "slot long")), bits)


def _phrases(batches: Iterator[pa.RecordBatch], filters: list[Broadcast], longest: int) -> Iterator[pa.RecordBatch]:
    """Of each shard, its words and phrases that pass the filters: rows (lang, phrase, n)."""
    own = [f.value for f in filters]
    for shard in _read(batches):
        known = np.flatnonzero(own[0](shard.keys[1:]))
        yield _rows(shard.lang, shard.names.take(pa.array(known)), np.bincount(shard.places, minlength=len(shard.keys))[1:][known])
        for length, (key, count, last, places) in enumerate(shard.substrings(own[:2], longest), 2):
            kept = np.flatnonzero(own[2](key)) if length > 2 else np.arange(len(key))
            for begin in range(0, len(kept), 100_000):
                part = kept[begin : begin + 100_000]
                names = [shard.names.take(pa.array(places[last[part] - back] - 1)) for back in range(length - 1, -1, -1)]
                yield _rows(shard.lang, pc.binary_join_element_wise(*names, b" "), count[part])


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])


def _part(words: Column, begin: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def _key(part: Column) -> Column:
    return F.concat(F.col("lang"), F.lit("\n"), part)  # words have no line ends


def lowest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a, n), with l, r and score of their lowest-scoring cut; counts: (lang, phrase, a) of all parts."""
    words = F.split("phrase", " ")
    cuts = candidates.select("*", words.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cut(cuts.select("lang", "phrase", "a", "n", "k", _key(_part(F.col("words"), 1, F.col("k"))).alias("first"), _key(_part(F.col("words"), F.col("k") + 1, F.size("words"))).alias("rest")))
    total = cuts.count()
    known = counts.select(_key(F.col("phrase")).alias("part"), F.col("a").alias("f"))
    for side, name in (("first", "l"), ("rest", "r")):
        parts = cuts.groupBy(side).agg(F.count("*").alias("m"))
        parts = parts.join(known, F.col(side) == F.col("part")).select(side, "m", F.col("f").alias(name))
        cuts = join_groups(cuts, parts, side, "m", total).drop("m")
    above = (F.col("a") * 1000).cast("decimal(20,0)") * F.col("n").cast("decimal(17,0)")
    below = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    cuts = cuts.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def not_covered(candidates: DataFrame, cover: int) -> DataFrame:
    """The candidates (lang, phrase, a) without those to which a link leads from one as frequent, or cover hundredths of that."""
    words = F.split("phrase", " ")
    size = F.size(words)
    links = candidates.where(size > 2).select("lang", "a", F.explode(F.array(_part(words, 2, size), _part(words, 1, size - 1))).alias("inner"))
    most = links.groupBy("lang", "inner").agg(F.max("a").alias("most")).withColumnRenamed("lang", "inner_lang")
    found = candidates.join(most, (F.col("lang") == F.col("inner_lang")) & (F.col("phrase") == F.col("inner")), "left")
    return found.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover)).select(candidates.columns)


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to `longest` words that come `least` times or more."""
    shards = shards_of(docs, text_col, lang_col, shard_bytes)
    langs = cut(shards.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n")))
    words = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = shards.drop("n")
    filters: list[Broadcast] = []
    for _ in range(3 if longest > 2 else 2):  # words, pairs, longer phrases
        filters.append(can_be_frequent(shards, filters, least, longest, words))
    found = shards.mapInArrow(partial(_phrases, filters=filters, longest=longest), "lang string, phrase string, n long")
    counts = cut(found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    candidates = counts.where(F.col("phrase").contains(" "))
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    left = not_covered(candidates, cover).join(langs, F.col("lang") == F.col("of_lang")).drop("of_lang")
    scored = lowest_cuts(left, counts)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
