"""Sets of word n-grams as 64-bit hashes, whole batches of texts at a time.

Words are runs of non-space bytes with A-Z lower-cased; a text with fewer words than n has one n-gram,
of all its words; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed together.
SPAN = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.random.default_rng(8).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A value per byte; A-Z have those of a-z."""
    return np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)[np.frombuffer(_LOWER, np.uint8)]


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words data[start:end], from running sums over spans of about SPAN bytes."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        n = max(SPAN, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_letters()[data[a:b]] * _powers(_BASE, n)[: b - a], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * _powers(_INVERSE, n)[starts[i:j] - a]
        i = j
    return _mix(out)


def _gram_hashes(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts data[bounds[k]:bounds[k + 1]]: hashes of their n-grams, not distinct, and where each text's begin and end."""
    texts = len(bounds) - 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]  # a text's end also ends its last word
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.nonzero(begins)[0], np.nonzero(stops)[0] + 1
    words = _word_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)  # each text's first word
    count = np.diff(first)
    grams = np.zeros(len(words), np.uint64)
    for size in range(1, n + 1):  # texts with fewer words than n have one gram, of all their words
        if size < n:
            at = first[:-1][count == size]
        elif (count >= n).any():
            at = np.arange(len(words) - n + 1)
        else:
            continue
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total += words[at + k] * _GRAM[k % len(_GRAM)] + np.uint64(k)
        if size < n:
            grams[at] = _mix(total) >> np.uint64(1)
        else:
            short = np.repeat(count < n, count)[: len(at)]
            grams[: len(at)] = np.where(short, grams[: len(at)], _mix(total) >> np.uint64(1))
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return grams, np.stack([first[:-1], first[:-1] + size], 1).reshape(texts, 2)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The column's bytes and the texts' bounds, in pieces of about SPAN bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SPAN, "right")) - 1)
        yield every[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k]
        k = j


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text, hashes of the distinct n-grams of words, ascending; the highest bit is 0."""
    for data, bounds in _texts(column):
        grams, places = _gram_hashes(data, bounds, n)
        for a, b in places.tolist():
            found = np.sort(grams[a:b])
            yield found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def shingles(text: str | None, n: int) -> np.ndarray:
    return next(sets_of(pa.array([text], pa.string()), n))


def fingerprint(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.astype("<u8").tobytes())
