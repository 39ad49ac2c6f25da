"""Vectorised word and shingle hashes of text columns, shared by the Arrow-batch operators.

Every function works on one slice of whole documents at a time, so memory follows the slice, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters of a word: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Characters of a word: digits, ASCII letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64, grown on demand."""
    if len(_powers[kind]) < n:
        base = np.uint64(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64))
        size = max(n, SLICE_BYTES + 1)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out = np.cumprod(factors, dtype=np.uint64)
        if size > 16 * SLICE_BYTES:
            return out[:n]
        _powers[kind] = out
    return _powers[kind][:n]


class Words:
    """The words of some documents: byte spans, hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, letters: np.ndarray):
        self.data, self.bounds = LOWER[data], bounds
        inside = letters[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: first[d]:first[d+1] are the words of document d
        self.first = np.searchsorted(self.start, bounds)
        up = _power("up", len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * up, out=self._sums[1:])

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hashes(self.start, self.end)


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of whole documents; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a])
        a = b


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles.

    Fewer words than a shingle has make one shingle; no words make an empty set.
    """
    h = words.hashes()
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h) - size + 1
    full = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * odd[k]
    full = mix(full)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            short = (h[a:b] * odd[: b - a]).sum(dtype=np.uint64)
            yield mix(np.array([short + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
