"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has one encoding, so it has one last token.  A sequence of tokens is the encoding
of its bytes exactly if each two neighbours are the encoding of theirs: a merge across a boundary that
happened in the whole would also happen in the two alone.  So the last token of a prefix is the only
token that ends there and is *compatible* with the last token of what stands before it.  `Vocabulary.extend`
fills in that table from left to right; the ids are read off it from the end.  What is appended later, or
follows an edit, only fills in the rest of the table (`EncodedText`).

A text is first matched by a pattern, and each match is encoded by itself; a match that is a token as a
whole is that token.  Ids of matches seen lately are remembered in two generations of bounded size.

Texts are encoded where they lie; nothing shuffles, and memory follows the longest text.  Defined cases:
a null or empty text has no tokens, and the digests of nothing; rows with the same id are encoded each for
itself; columns other than id and text aren't used; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Matches that a Python worker remembers at most, and the longest of them; pairs of tokens that it remembers.
REMEMBERED, LONGEST, PAIRS = 1_200_000, 64, 1_000_000
#: Characters that are matched in one go, matches taken at a time of a longer text, and texts taken at a time.
WHOLE, MATCHES, ROWS = 1 << 21, 100_000, 1_000
#: So many characters after its end can decide where a match of the pattern ends.
AHEAD = 2
#: The rank of a merge that never comes.
NEVER = 1 << 62
#: White space as Unicode has it, which is what the pattern's \s stands for.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by rank, and the ids of matches of the pattern as far as they are remembered (little-endian 32-bit integers)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = list(map(len, self.tokens))
        self.decimal = list(map(str, range(len(self.tokens))))
        self.reach: dict[bytes, int] = {}  # the longest token that ends in these three bytes
        for token in ranks:
            if len(token) > self.reach.get(token[-3:], 2):
                self.reach[token[-3:]] = len(token)
        spaced = pattern.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\s", SPACE).replace(r"\S", "[^" + SPACE[1:])
        self.pattern = regex.compile(spaced)
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple | None] = {}
        self.ordered = True  # so far, each merge at a token's edge had a higher rank than those before

    def merged(self, text: bytes) -> tuple[list[bytes], list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts that are left of a few bytes by merging neighbours, the lowest rank first, as long as any two make a token;
        and the parts that stood at the left and at the right edge in turn, each with the rank of the merge that took it."""
        parts = [text[k : k + 1] for k in range(len(text))]
        left, right = [], []
        while True:
            best = min(((rank, k) for k in range(len(parts) - 1) if (rank := self.ranks.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)]
            rank, k = best
            if k == 0:
                left.append((parts[0], rank))
            if k == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def edges(self, token: int) -> tuple | None:
        """What stood at the left and at the right edge of a token while it was merged; None if merges don't make it."""
        if token not in self.made:
            parts, *edges = self.merged(self.tokens[token])
            self.made[token] = tuple(edges) if len(parts) == 1 else None
            self.ordered &= all(a[1] < b[1] for edge in edges for a, b in pairwise(edge))
        return self.made[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes; left -1: whether right alone is."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        after = self.edges(right)
        before = self.edges(left) if left >= 0 else after
        if before is None or after is None or left < 0:
            return after is not None and before is not None
        if not self.ordered:  # a token has a lower rank than its parts: merge the two and see
            return self.merged(self.tokens[left] + self.tokens[right])[0] == [self.tokens[left], self.tokens[right]]
        own, other = iter(before[1]), iter(after[0])
        (a, taken_a), (b, taken_b) = next(own), next(other)
        while True:  # of merges of the same rank the one to the left comes first
            across = self.ranks.get(a + b, NEVER)
            if across < taken_a and across <= taken_b and across != NEVER:
                return False
            if taken_a == taken_b == NEVER:
                return True
            if taken_a <= taken_b:
                a, taken_a = next(own)
            else:
                b, taken_b = next(other)

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Add to last, which holds the last tokens of the shorter prefixes of piece, those of the others.

        As there is only one, they can be tried in any order: first the token before, one byte longer, then the others from the longest on."""
        ranks, pairs, reach, size = self.ranks, self.pairs, self.reach, self.size
        for end in range(len(last) + 1, len(piece) + 1):
            if last:
                start = end - 1 - size[last[-1]]
                token = ranks.get(piece[start:end])
                if token is not None:
                    before = last[start - 1] if start else -1
                    known = pairs.get((before, token))
                    if known or (known is None and self.compatible(before, token)):
                        last.append(token)
                        continue
            for start in range(max(0, end - reach.get(piece[max(0, end - 3) : end], 2)), end):
                token = ranks.get(piece[start:end])
                if token is not None:
                    before = last[start - 1] if start else -1
                    known = pairs.get((before, token))
                    if known or (known is None and self.compatible(before, token)):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token for the byte {piece[end - 1]}")

    def read_off(self, piece: bytes, last: list[int]) -> list[int]:
        """The ids of piece, from its prefixes' last tokens."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids, end = [], len(piece)
        while end:
            ids.append(last[end - 1])
            end -= self.size[ids[-1]]
        return ids[::-1]

    def learn(self, matches: Iterable[str]) -> list[str]:
        """Remember the ids of all these matches, in their order, so that each takes over the table of what it has in common with the one before; returns the long ones that are new."""
        if len(self.recent) > REMEMBERED // 2:  # matches in use come over from the earlier generation
            self.earlier, self.recent = self.recent, {}
        new = []
        for match in set(matches).difference(self.recent):
            packed = self.earlier.get(match)
            if packed is None:
                new.append(match.encode())
            else:
                self.recent[match] = packed
        before, last = b"", []
        for piece in sorted(new):
            if piece in self.ranks:
                ids = [self.ranks[piece]]
            else:
                del last[shared(before, piece) :]
                self.extend(piece, last)
                before, ids = piece, self.read_off(piece, last)
            self.recent[piece.decode()] = array("I", ids).tobytes()
        return [match for match in map(bytes.decode, new) if len(match) > LONGEST]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(place in texts, ids), in order; a long text comes in several parts, an empty one not at all."""
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for k, text in enumerate(texts):
            if len(text) > WHOLE:
                found = self.pattern.finditer(text)
                for part in iter(lambda found=found: [m[0] for m in islice(found, MATCHES)], []):
                    yield from self._ids([*held, (k, part)])
                    held, chars = [], 0
                continue
            held.append((k, self.pattern.findall(text)))
            chars += len(text)
            if chars > WHOLE:
                yield from self._ids(held)
                held, chars = [], 0
        yield from self._ids(held)

    def _ids(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        long = self.learn(chain.from_iterable(part for _, part in held))
        for k, part in held:
            if part:
                yield k, np.frombuffer(b"".join(map(self.recent.__getitem__, part)), np.uint32)
        for match in long:
            del self.recent[match]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def shared(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with in common."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return min(len(a), len(b))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


class EncodedText:
    """A text, its matches and their tables of last tokens, kept right under edits."""

    def __init__(self, own: Vocabulary, text: str = ""):
        self.own, self.text = own, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.found = 0  # prefixes whose last token had to be looked for, in all
        self.replace(0, 0, text)

    def _piece(self, k: int) -> bytes:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[k] : end].encode()

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, by: str) -> None:
        """Put by in the place of the characters from start to stop: match again from the first match that could see them, until a match begins where one began before."""
        first = max(0, bisect_right(self.starts, start - AHEAD) - 1)
        old = {self.starts[k]: k for k in range(first, len(self.starts))}
        text, moved = self.text[:start] + by + self.text[stop:], len(by) - (stop - start)
        at = self.starts[first] if self.starts else 0
        starts, tables, after = [], [], len(self.starts)
        while at < len(text):
            if at >= start + len(by) and at - moved in old:
                after = old[at - moved]
                break
            end = self.own.pattern.match(text, at).end()
            piece, table = text[at:end].encode(), []
            if at <= start and at in old:  # what the match had in common with the one that began here stays
                table = self.tables[old[at]][: shared(self._piece(old[at]), piece)]
            self.found += len(piece) - len(table)
            self.own.extend(piece, table)
            starts.append(at)
            tables.append(table)
            at = end
        self.starts[first:] = starts + [s + moved for s in self.starts[after:]]
        self.tables[first:] = tables + self.tables[after:]
        self.text = text

    def ids(self) -> list[int]:
        return [t for k, table in enumerate(self.tables) for t in self.own.read_off(self._piece(k), table)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = vocabulary(path, pattern)
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            texts = [text or "" for text in part.column("text").to_pylist()]
            count = [0] * len(texts)
            listed, decoded = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            packed: list[list[bytes]] = [[] for _ in texts]
            for k, ids in own.encode(texts):
                numbers = ids.tolist()
                listed[k].update(b"," * (count[k] > 0) + ",".join(map(own.decimal.__getitem__, numbers)).encode())
                decoded[k].update(own.decode(numbers))
                count[k] += len(numbers)
                if with_ids:
                    packed[k].append(ids.tobytes())
            columns = [part.column("id"), pa.array(count, pa.int64()), pa.array([x.hexdigest() for x in listed], pa.string()), pa.array([x.hexdigest() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(x) if with_ids else None for x in packed], pa.binary())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids stand for), ids (little-endian 32-bit integers; null unless with_ids)."""
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = texts.schema["id"].dataType
    encode = partial(_encode, path=path or ranks_path(), pattern=pattern or default_pattern(), with_ids=with_ids)
    return texts.mapInArrow(encode, f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = vocabulary(path, pattern)
    for batch in batches:
        decoded = [None if ids is None else own.decode(np.frombuffer(ids, "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decoded, pa.binary())], names=["id", "bytes"])


def decode_documents(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes) of rows with ids as encode_documents gives them; null ids give null."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(partial(_decode, path=path or ranks_path(), pattern=default_pattern()), f"id {rows.schema['id'].dataType.simpleString()}, bytes binary")


def _edit(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = vocabulary(path, pattern)
    for batch in batches:
        ids, found = [], []
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
            encoded = EncodedText(own, text or "")
            before = encoded.found
            for edit in edits or []:
                start = min(max(edit["start"] or 0, 0), len(encoded.text))
                encoded.replace(start, min(max(edit["stop"] or 0, start), len(encoded.text)), edit["text"] or "")
            ids.append(np.array(encoded.ids(), "<u4").tobytes())
            found.append(encoded.found - before)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), pa.array(found, pa.int64())], names=["id", "ids", "looked_for"])


def encode_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """(id, ids, looked_for) of texts after their edits (an array of structs start, stop, text, one after the other; places in characters, held to the text's).

    The table of last tokens of the text before is kept, and looked_for tells for how many bytes the edits made it look again."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[edits_col].alias("edits"))
    return rows.mapInArrow(partial(_edit, path=path or ranks_path(), pattern=default_pattern()), f"id {rows.schema['id'].dataType.simpleString()}, ids binary, looked_for long")
