"""Canonical varints and the static byte rANS block."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

from .errors import Rejected

#: Fixed values of the format: precision and lower bound of the state.
BITS, SCALE, LOW = 12, 4096, 1 << 23


def put_uvarint(v: int, out: bytearray) -> None:
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


def zigzag(v: int) -> int:
    return ((v << 1) ^ (v >> 31)) & 0xFFFFFFFF


def unzigzag(z: int) -> int:
    return (z >> 1) ^ -(z & 1)


def put_svarint(v: int, out: bytearray) -> None:
    put_uvarint(zigzag(v), out)


class Cursor:
    """Reads bytes and canonical varints; ``where`` names the layer in rejections."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise Rejected("UnexpectedEof")
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Rejected("UnexpectedEof")
        self.at += n
        return self.data[self.at - n : self.at]

    def uvarint(self) -> int:
        v = 0
        for k in range(10):
            b = self.byte()
            if k == 9 and b & 127 > 1:
                raise Rejected("VarintOverflow")
            v |= (b & 127) << 7 * k
            if b < 128:
                if k and b == 0:
                    raise Rejected("OverlongVarint")
                return v
        raise Rejected("VarintTooLong")

    def svarint(self) -> int:
        z = self.uvarint()
        if z >> 32:
            raise Rejected("VarintOverflow")
        return unzigzag(z)

    def end(self) -> None:
        if self.at != len(self.data):
            raise Rejected("TrailingData")


def normalised(data: bytes) -> list[int]:
    """Frequencies that sum to SCALE: floors (at least 1), then one each to the largest remainders, highest symbol first among equals.

    Where the floors' minimum of one has overshot, the most frequent symbols give it back.
    """
    count = Counter(data) or {0: 1}
    n = sum(count.values())
    freq = [0] * 256
    for s, c in count.items():
        freq[s] = max(c * SCALE // n, 1)
    left = SCALE - sum(freq)
    for s in sorted(count, key=lambda s: (count[s] * SCALE % n, s), reverse=True)[: max(left, 0)]:
        freq[s] += 1
        left -= 1
    if left > 0:  # every remainder is used up: the rest goes to the highest symbol
        freq[max(count)] += left
    while left < 0:
        s = max((s for s in count if freq[s] > 1), key=lambda s: (count[s], s))
        freq[s] -= 1
        left += 1
    return freq


def starts(freq: list[int]) -> list[int]:
    """Exclusive running sum."""
    return [0, *np.cumsum(freq).tolist()[:-1]]


def compress(data: bytes) -> bytes:
    """An entropy block: rANS where that is smaller, else raw."""
    raw = b"\0" + struct.pack("<I", len(data)) + data
    if not data:
        return raw
    freq = normalised(data)
    first = starts(freq)
    rows = [(f, f << 19, SCALE - f, c) for f, c in zip(freq, first, strict=True)]
    state, out = LOW, bytearray()
    for f, limit, gain, c in map(rows.__getitem__, reversed(data)):
        while state >= limit:
            out.append(state & 255)
            state >>= 8
        state += state // f * gain + c
    out.reverse()
    used = [s for s in range(256) if freq[s]]
    head = bytearray(b"\2" + struct.pack("<IH", len(data), len(used)))
    for s in used:
        head.append(s)
        put_uvarint(freq[s], head)
    coded = bytes(head) + struct.pack("<II", len(out) + 4, state) + bytes(out)
    return coded if len(coded) < len(raw) else raw


def decompress(block: bytes, most: int) -> bytes:
    """The bytes of an entropy block of at most ``most``."""
    c = Cursor(block)
    if len(block) < 5:
        raise Rejected("UnexpectedEof")
    mode = c.byte()
    (size,) = struct.unpack("<I", c.take(4))
    if mode not in (0, 2) or size > most:
        raise Rejected("BadEntropyHeader")
    if mode == 0:
        out = c.take(size)
        c.end()
        return out
    (used,) = struct.unpack("<H", c.take(2))
    if not 1 <= used <= 256:
        raise Rejected("BadEntropyModel")
    freq = [0] * 256
    for _ in range(used):
        s, f = c.byte(), c.uvarint()
        if freq[s] or not 1 <= f <= SCALE:
            raise Rejected("BadEntropyModel")
        freq[s] = f
    if sum(freq) != SCALE:
        raise Rejected("BadEntropyModel")
    (coded,) = struct.unpack("<I", c.take(4))
    body = c.take(coded)
    c.end()
    if coded < 4:
        raise Rejected("BadEntropyState")
    state = int.from_bytes(body[:4], "little")
    if state < LOW:
        raise Rejected("BadEntropyState")
    symbol = np.repeat(np.arange(256), freq).tolist()
    first, at, out = starts(freq), 4, bytearray(size)
    for i in range(size):
        x = state & SCALE - 1
        s = out[i] = symbol[x]
        state = freq[s] * (state >> BITS) + x - first[s]
        while state < LOW:
            if at >= coded:
                raise Rejected("UnexpectedEof")
            state = state << 8 | body[at]
            at += 1
    if at != coded:
        raise Rejected("TrailingData")
    return bytes(out)
