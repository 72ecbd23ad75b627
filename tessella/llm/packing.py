"""Packing token sequences by best-fit decreasing.

Documents are tokenized where they lie, end with one id, and are cut into full windows and a rest.  The
pieces (a few numbers each, and their ids if asked for) are dealt out evenly to shards of about
`SHARD_PIECES` pieces, as many shards as the input needs.  A shard places its pieces from the longest
to the shortest, each into the tightest window that still has room; a segment tree over remaining
capacities finds it.  So a task's memory is bounded by the shard's size, and padding is what a shard
leaves in its last windows.  A sequence is padded to the window, unless its tokens are a power of two.

Splitting a text at ASCII white space doesn't change its ids, as this vocabulary's tokens never cross
white space; so ids are looked up word by word, and only words not seen lately go to the tokenizer.

Defined cases: a null or empty text is the end id alone; rows with the same id are packed each for
itself; other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from tessella.llm.tables import cut, texts_in_small_batches

WINDOW = 4096
END_ID = 2
SHARD_PIECES = 20_000
#: Words whose ids a Python worker remembers at most, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64

_SPACE = re.compile(r"[ \t\r\n]+")
#: Words that the vocabulary's normalizer only lower-cases, and their parts as its pre-tokenizer cuts them.
_PLAIN = re.compile(r"(?!.*<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """ids of words, as little-endian 32-bit integers; of words not seen lately by the tokenizer, its model alone where that is all a word needs.

    Half of what is remembered goes at a time, and words in use come over from it, so frequent ones stay."""

    def __init__(self, path: str):
        super().__init__()
        self.earlier: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        if (ids := self.get(part) or self.earlier.get(part)) is None:
            letters = part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        return ids

    def __missing__(self, word: str) -> bytes:
        if (ids := self.earlier.get(word)) is not None:
            self[word] = ids
            return ids
        if _PLAIN.fullmatch(word):
            first, *rest = _PARTS.findall(word.lower())
            ids = self._part(first)
            if rest and len(first) <= LONGEST:
                self[first] = ids
            ids += b"".join(map(self._part, rest))
        else:
            ids = b"".join([x.to_bytes(4, "little") for x in self.tokenizer.encode(word, add_special_tokens=False).ids])
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > REMEMBERED // 2:
            self.earlier = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _SPACE.split(text)))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, kind: pa.DataType, window: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    ids_of = word_ids(path or tokenizer_path())
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            ids = ids_of.of(text.as_py() or "") + end
            for start in range(0, len(ids), 4 * window):
                piece = ids[start : start + 4 * window]
                rows.append((doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
            held += len(ids) if with_ids else 0
            if held > 1 << 24:
                yield _pieces(rows, kind)
                rows, held = [], 0
        yield _pieces(rows, kind)


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"]


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, ids): full windows and a rest of each document; ids are little-endian 32-bit integers, null unless with_ids."""
    texts = texts_in_small_batches(docs).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = texts.schema["id"].dataType
    schema = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return texts.mapInArrow(partial(_cut, path=path, kind=to_arrow_type(kind), window=window, end_id=end_id, with_ids=with_ids), schema)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that tells which capacities have any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()  # capacities 0 to window
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of at least `least`, and that capacity."""
        node = self.leaves + least
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's sequence and offset, and each sequence's tokens."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = OpenWindows(window)
    n = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        found = opened.take(length)
        if found is None:
            at, capacity = n, window
            n += 1
        else:
            at, capacity = found
        sequence[k], offset[k] = at, window - capacity
        opened.put(capacity - length, at)
    return sequence, offset, np.bincount(sequence, weights=lengths, minlength=n).astype(np.int64)


def _place(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    full = [b for b in batches if b.num_rows]
    if not full:
        return
    table = pa.Table.from_batches(full)
    lengths = table.column("length").to_numpy()
    sequence, offset, tokens = best_fit(lengths, window)
    tokens = tokens[sequence]
    padded = np.where(tokens & (tokens - 1), window, tokens)
    first = TaskContext.get().partitionId() << 32
    for name, values in (("sequence_id", first + sequence), ("offset", offset), ("sequence_tokens", tokens), ("padded_tokens", padded)):
        table = table.append_column(name, pa.array(values, pa.int64()))
    yield from table.to_batches(max_chunksize=10_000)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces with sequence_id, offset, sequence_tokens and padded_tokens (of their sequence)."""
    pieces = cut(pieces)
    shards = -(-pieces.count() // shard_pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, sequence_tokens long, padded_tokens long"
    return pieces.repartition(max(1, shards)).mapInArrow(partial(_place, window=window), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; with_ids: and their ids."""
    packed = pack(cut_documents(docs, id_col, text_col, path, with_ids=with_ids))
    return packed if with_ids else packed.drop("ids")
