"""Vectorised word and window hashing over Arrow buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Identity is a 64-bit
polynomial hash (odd base, wrapped at 2**64) with the length mixed in and a final
avalanche; two given words meet with a chance near 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes of text that one step works on, so that its arrays stay in the processor's caches.
STEP = 1 << 20
END = U(0x5851F42D4C957F2D)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i <= n."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(max(n + 1, STEP + 1), b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Block:
    """Some whole texts: their bytes, the words' spans and hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool):
        self.first, self.n, self.raw = first, len(offsets) - 1, data
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        space = SPACE[data]
        self.space = space
        if len(data) == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.word = np.zeros(0, U)
            self.ptr = np.zeros(self.n + 1, np.int64)
            self._prefix = np.zeros(1, U)
            return
        before = np.empty(len(data), bool)
        before[0] = True
        before[1:] = space[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = True
        after = np.empty(len(data), bool)
        after[-1] = True
        after[:-1] = space[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = True
        word = ~space
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        p, _ = powers(len(data))
        self._prefix = np.zeros(len(data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * p[: len(data)], out=self._prefix[1:])
        self.word = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = powers(len(self.data))
        h = (self._prefix[end] - self._prefix[start]) * inv[start]
        return mix(h + (end - start).astype(U) * U(0x2545F4914F6CDD1D))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.ptr)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows inside texts, and the index of each one's first word."""
        n = len(self.word)
        if n < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.zeros(n - k + 1, U)
        for j in range(k):
            h = h * U(0x9E3779B97F4A7C15) + self.word[j : n - k + 1 + j]
        left = np.repeat(self.ptr[1:], self.n_words) - np.arange(n)
        at = np.flatnonzero(left[: n - k + 1] >= k)
        return mix(h[at] + U(k)), at

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each text, sorted in it, and the texts' pointers into them.

        A text of 1 to k-1 words has its whole sequence as its one shingle.
        """
        h, at = self.windows(k)
        doc = np.searchsorted(self.ptr, at, side="right") - 1
        few = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if len(few):
            short = np.zeros(len(few), U)
            for j in range(k - 1):
                has = self.n_words[few] > j
                short[has] = short[has] * U(0x9E3779B97F4A7C15) + self.word[self.ptr[few[has]] + j]
            h = np.concatenate([h, mix(short + self.n_words[few].astype(U) * U(0xA0761D6478BD642F))])
            doc = np.concatenate([doc, few])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
        return h, np.searchsorted(doc, np.arange(self.n + 1))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(texts: pa.Array, lower: bool) -> Iterator[Block]:
    """Whole texts in steps of about STEP bytes; a longer text is a step of its own."""
    if len(texts) == 0:
        return
    raw, at = buffers(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, side="right")) - 1)
        yield Block(raw[at[i] : at[j]], at[i : j + 1] - at[i], i, lower)
        i = j
