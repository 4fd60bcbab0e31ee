"""CRC-32C, vectorised over lanes of a long message and joined by the linear map of a lane's length."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Fixed values of the format: Castagnoli polynomial, reflected; check value of b"123456789".
POLYNOMIAL, CHECK = 0x82F63B78, 0xE3069283
LANE = 256


@functools.cache
def table() -> np.ndarray:
    """What each byte does to the low byte of a state."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _steps(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Advance each lane's state over its row of bytes."""
    t = table()
    for k in range(columns.shape[1]):
        state = t[(state ^ columns[:, k]) & 0xFF] ^ (state >> np.uint32(8))
    return state


@functools.cache
def _lane_map() -> list[list[int]]:
    """What LANE zero bytes do to each value of each of the four bytes of a state."""
    out = []
    for byte in range(4):
        s = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        out.append(_steps(s, np.zeros((256, LANE), np.uint32)).tolist())
    return out


def crc32c(data: bytes | memoryview | np.ndarray) -> int:
    """CRC-32C of a byte string."""
    b = np.frombuffer(data, np.uint8)
    lanes = len(b) // LANE
    state = 0xFFFFFFFF
    if lanes >= 4:
        own = _steps(np.zeros(lanes, np.uint32), b[: lanes * LANE].reshape(lanes, LANE).astype(np.uint32)).tolist()
        m0, m1, m2, m3 = _lane_map()
        for x in own:
            state = m0[state & 255] ^ m1[state >> 8 & 255] ^ m2[state >> 16 & 255] ^ m3[state >> 24] ^ x
        b = b[lanes * LANE :]
    t = _list()
    for x in b.tolist():
        state = t[(state ^ x) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def crc32c_many(texts: pa.Array) -> np.ndarray:
    """CRC-32C of every value of a binary array, all of them advanced together.

    Whole lanes of LANE bytes of all values are rows of one matrix; a value's lanes are then joined in order, the k-th
    lanes of all values at once, and its last bytes follow in the same way.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, size = at[:-1], np.diff(at)
    lanes, left = size // LANE, size % LANE
    first = np.cumsum(lanes) - lanes
    k = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    rows = np.repeat(start, lanes) + k * LANE
    own = np.zeros(len(rows), np.uint32)
    for lo in range(0, len(rows), 1 << 14):
        own[lo : lo + (1 << 14)] = _steps(np.zeros(len(rows[lo : lo + (1 << 14)]), np.uint32), raw[rows[lo : lo + (1 << 14), None] + np.arange(LANE)].astype(np.uint32))
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    moved = _lane_arrays()
    order = np.argsort(-lanes, kind="stable")
    for n in range(int(lanes.max(initial=0))):
        live = order[: np.searchsorted(-lanes[order], -n, side="left")]
        s = state[live]
        state[live] = moved[0][s & 255] ^ moved[1][s >> 8 & 255] ^ moved[2][s >> 16 & 255] ^ moved[3][s >> 24] ^ own[first[live] + n]
    order = np.argsort(-left, kind="stable")
    t = table()
    for n in range(int(left.max(initial=0))):
        live = order[: np.searchsorted(-left[order], -n, side="left")]
        s = state[live]
        state[live] = t[(s ^ raw[start[live] + lanes[live] * LANE + n]) & 255] ^ (s >> np.uint32(8))
    return (state ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


@functools.cache
def _lane_arrays() -> list[np.ndarray]:
    return [np.array(x, np.uint32) for x in _lane_map()]


@functools.cache
def _list() -> list[int]:
    return table().tolist()
