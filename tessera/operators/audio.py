"""Audio packets: integer lifting wavelet over 64-sample blocks, scalar quantiser, sparse tokens."""

from __future__ import annotations

import math
import struct

import numpy as np

from .entropy import Cursor, compress, decompress, put_svarint, put_uvarint
from .errors import Rejected
from .wire import MAX_ENTROPY

#: Fixed values of the format.
MAGIC, BLOCK, MAX_FRAMES, MAX_COEFFICIENT = b"ALA1", 64, 4096, 2_000_000
RATES, CHANNELS = (8_000, 384_000), (1, 8)
_HEAD = struct.Struct("<4sBBHIHHI")


def divisors(q: int) -> np.ndarray:
    """The quantiser of each coefficient."""
    i = np.arange(BLOCK)
    return np.ones(BLOCK, np.int64) if q <= 1 else q * np.where(i < 4, 1, np.where(i < 16, 2, 3))


def div_round(v: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """Nearest, halves away from zero."""
    return np.sign(v) * ((np.abs(v) + d // 2) // d)


def haar(x: np.ndarray) -> np.ndarray:
    """Forward transform of rows of 64."""
    x = x.astype(np.int64, copy=True)
    n = BLOCK
    while n > 1:
        a, b = x[:, 0:n:2].copy(), x[:, 1:n:2].copy()
        d = b - a
        x[:, : n // 2], x[:, n // 2 : n] = a + (d >> 1), d
        n //= 2
    return x


def _fits32(*values: np.ndarray) -> None:
    for v in values:
        if v.size and (v.max() > 0x7FFFFFFF or v.min() < -0x80000000):
            raise Rejected("SampleOverflow")


def inverse_haar(x: np.ndarray) -> np.ndarray:
    """Inverse of rows of 64; an intermediate outside 32 bits is rejected."""
    x = x.astype(np.int64, copy=True)
    _fits32(x)
    n = 2
    while n <= BLOCK:
        s, d = x[:, : n // 2].copy(), x[:, n // 2 : n].copy()
        a = s - (d >> 1)
        b = d + a
        _fits32(a, b)
        x[:, 0:n:2], x[:, 1:n:2] = a, b
        n *= 2
    return x


def planes(pcm: np.ndarray, channels: int, mid_side: bool) -> np.ndarray:
    """Channel planes of interleaved samples, coupled if asked."""
    p = pcm.reshape(-1, channels).T.astype(np.int64)
    if mid_side:
        side = p[1] - p[0]
        p = np.stack([p[0] + (side >> 1), side])
    return p


def interleaved(p: np.ndarray, mid_side: bool) -> np.ndarray:
    if mid_side:
        left = p[0] - (p[1] >> 1)
        _fits32(left)
        right = p[1] + left
        _fits32(right)
        p = np.stack([left, right])
    if p.size and (p.max() > 32767 or p.min() < -32768):
        raise Rejected("SampleOverflow")
    return p.T.reshape(-1).astype(np.int16)


def tokens(q: np.ndarray, out: bytearray) -> None:
    """Sparse form of rows of coefficients."""
    for row in q:
        at = np.flatnonzero(row)
        put_uvarint(len(at), out)
        for i in at.tolist():
            put_uvarint(i, out)
            put_svarint(int(row[i]), out)


def read_sparse(c: Cursor, most: int, into: list[int]) -> None:
    """One block's coefficients; indexes must rise and values stay within ``most``. Single bytes, the rule, are read in place."""
    n = c.uvarint()
    if n > 64:
        raise Rejected("BadCoefficient")
    last, data, end = -1, c.data, len(c.data)
    for _ in range(n):
        at = c.at
        if at + 1 < end and data[at] < 128 and data[at + 1] < 128:
            i, z = data[at], data[at + 1]
            v = (z >> 1) ^ -(z & 1)
            c.at = at + 2
        else:
            i, v = c.uvarint(), c.svarint()
        if i >= 64 or i <= last or abs(v) > most:
            raise Rejected("BadCoefficient")
        into[i], last = v, i


def encode(pcm: np.ndarray, rate: int, channels: int, q: int = 1, mid_side: bool = False) -> bytes:
    """One packet's payload; rejected if the decoder would leave 16 bits."""
    if not CHANNELS[0] <= channels <= CHANNELS[1] or mid_side and channels != 2:
        raise Rejected("BadChannels")
    if not RATES[0] <= rate <= RATES[1]:
        raise Rejected("BadRate")
    if not 1 <= q <= 65535:
        raise Rejected("BadQuantizer")
    frames = len(pcm) // channels
    if len(pcm) % channels or not 1 <= frames <= MAX_FRAMES:
        raise Rejected("BadFrames")
    blocks = -(-frames // BLOCK)
    p = np.zeros((channels, blocks * BLOCK), np.int64)
    p[:, :frames] = planes(np.asarray(pcm), channels, mid_side)
    d = divisors(q)
    coded = div_round(haar(p.reshape(-1, BLOCK)), d)
    if q > 1:
        interleaved(inverse_haar(coded * d).reshape(channels, -1)[:, :frames], mid_side)
    out = bytearray()
    put_uvarint(blocks, out)
    tokens(coded, out)
    body = compress(bytes(out))
    return _HEAD.pack(MAGIC, channels, int(mid_side), q, rate, frames, 0, len(body)) + body


def decode(b: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, interleaved samples) of a payload."""
    if len(b) < _HEAD.size:
        raise Rejected("UnexpectedEof")
    magic, channels, flags, q, rate, frames, reserved, size = _HEAD.unpack_from(b)
    if magic != MAGIC:
        raise Rejected("BadHeader")
    if not CHANNELS[0] <= channels <= CHANNELS[1]:
        raise Rejected("BadChannels")
    if flags & ~1 or flags & 1 and channels != 2:
        raise Rejected("BadHeader")
    if q < 1:
        raise Rejected("BadQuantizer")
    if not RATES[0] <= rate <= RATES[1]:
        raise Rejected("BadRate")
    if not 1 <= frames <= MAX_FRAMES:
        raise Rejected("BadFrames")
    if reserved:
        raise Rejected("BadHeader")
    if len(b) != _HEAD.size + size:
        raise Rejected("UnexpectedEof" if len(b) < _HEAD.size + size else "TrailingData")
    c = Cursor(decompress(b[_HEAD.size :], MAX_ENTROPY))
    blocks = -(-frames // BLOCK)
    if c.uvarint() != blocks:
        raise Rejected("BadFrames")
    rows = [[0] * BLOCK for _ in range(channels * blocks)]
    for row in rows:
        read_sparse(c, MAX_COEFFICIENT, row)
    c.end()
    p = inverse_haar(np.array(rows, np.int64) * divisors(q)).reshape(channels, -1)[:, :frames]
    return rate, channels, interleaved(p, bool(flags & 1))


def snr_db(a: np.ndarray, b: np.ndarray) -> float:
    """Signal to noise of two equally long sample arrays; infinite if they agree."""
    if len(a) != len(b):
        raise Rejected("BadFrames")
    x, d = a.astype(np.int64), a.astype(np.int64) - b.astype(np.int64)
    noise = int((d * d).sum())
    return math.inf if noise == 0 else 10 * math.log10(max(int((x * x).sum()), 1) / noise)
