"""Counted 64-bit keys in sorted blobs by segment: what the shuffles of the token operators carry.

A segment is the leading bits of a key. Map tasks sum their own keys and send one row for
each segment; a reduce task sees all rows of its segments. Keys are hashes, so segments are
even whatever the words' frequencies: a hot word is one key of each map task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U

#: Keys that a map task sums before it sends them on.
FLUSH = 2_000_000


def segment_bits(parts: int) -> int:
    """Four to eight segments for each reduce task."""
    return int(np.clip(int(np.ceil(np.log2(max(parts, 1)))) + 2, 4, 20))


def dealt(df: DataFrame, parts: int, bits: int) -> DataFrame:
    """Rows by segment: neighbouring segments to one reduce task, as many to each."""
    return df.repartitionById(parts, F.shiftright(F.col("seg").cast("bigint") * parts, bits).cast("int"))


def sum_by_key(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending, and their sums (int64)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts.astype(np.int64), first)
    return keys[first], sums


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that occur in sorted keys, and where each begins (with the end)."""
    seg = (keys >> U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
    return seg[first], np.append(first, len(keys))


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary array of slices of an array, without copies."""
    values = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def joined(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """All blobs of a binary column, end to end, as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def give_back() -> None:
    """Return freed memory to the system: workers are kept between tasks, and others need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
