"""Entropy blocks in many lanes: each block is a lane, and all blocks of a batch are coded in step.

The state of one block depends on itself alone, symbol after symbol; those of many blocks do not depend on each other. Lanes are
ordered by length, so those that are still at work are always the first ones; the last few, of much longer blocks, are finished
one by one. The bytes are those of ``entropy.compress``; a block that is not as it should be is given to ``entropy.decompress``, whose
rejection it gets.
"""

from __future__ import annotations

import struct

import numpy as np

from . import entropy
from .entropy import BITS, LOW, SCALE
from .errors import Rejected

#: Lanes that are coded together, lanes at work below which each goes on by itself, and steps whose symbols are looked up together.
LANES, FEW, STEPS = 1024, 12, 64


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each lane has each byte."""
    n = len(at) - 1
    lane = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(lane * 256 + data[at[0] : at[-1]], minlength=n * 256).reshape(n, 256)


def normalised_many(count: np.ndarray) -> np.ndarray:
    """``entropy.normalised`` of many histograms, none of them empty."""
    total = count.sum(axis=1, keepdims=True)
    some, symbol = count > 0, np.arange(256)
    freq = np.where(some, np.maximum(count * SCALE // total, 1), 0)
    left = SCALE - freq.sum(axis=1)
    more = np.flatnonzero(left > 0)
    if len(more):
        some_, key = some[more], (count[more] * SCALE % total[more]) * 256 + symbol
        order = np.argsort(np.argsort(-np.where(some_, key, -1), axis=1, kind="stable"), axis=1, kind="stable")
        freq[more] += some_ & (order < left[more, None])
        rest = np.maximum(left[more] - some_.sum(axis=1), 0)
        freq[more, 255 - np.argmax(some_[:, ::-1], axis=1)] += rest
    less = np.flatnonzero(left < 0)
    if len(less):
        order = np.argsort(-np.where(some[less], count[less] * 256 + symbol, -1), axis=1, kind="stable")
        sorted_ = np.take_along_axis(freq[less], order, 1)
        spare = np.maximum(sorted_ - 1, 0)
        give = np.clip(-left[less, None] - (np.cumsum(spare, axis=1) - spare), 0, spare)
        np.put_along_axis(sorted_, np.arange(256)[None, :].repeat(len(less), 0), sorted_ - give, 1)
        back = freq[less]
        np.put_along_axis(back, order, sorted_, 1)
        freq[less] = back
    return freq


def _heads(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The models' bytes (symbol and frequency as a varint), end to end, and where each lane's begin."""
    lane, symbol = np.nonzero(freq)
    f = freq[lane, symbol]
    size = np.where(f < 128, 2, 3)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = symbol
    out[at + 1] = np.where(f < 128, f, f & 127 | 128)
    long = f >= 128
    out[at[long] + 2] = f[long] >> 7
    return out, np.append(0, np.cumsum(np.bincount(lane, size, len(freq)).astype(np.int64)))


def _encode(data: np.ndarray, end: np.ndarray, size: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each lane's last state and bytes; lanes by descending size.

    A state is below 2**31, so its quotient by a frequency f is (state * ceil(2**(31 + s) / f)) >> (31 + s), where 2**s is the first power not below f.
    """
    lanes, longest = len(size), int(size[0])
    first = np.cumsum(freq, axis=1) - freq
    table = (freq | first << 16).ravel()
    f = np.arange(1, SCALE + 1)
    bits = 31 + np.ceil(np.log2(f)).astype(np.int64)
    inverse, bits = np.append(0, -(-(1 << bits) // f)), np.append(0, bits)
    state, base = np.full(lanes, LOW, np.int64), (np.arange(lanes) * 256)[None, :]
    live = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    out: list[list[bytes]] = [[] for _ in range(lanes)]
    room = np.empty(lanes, np.int64)
    t = 0
    while t < longest and (n := live[t]) >= FEW:
        steps = min(STEPS, longest - t)
        fs = table[base[:, :n] + data[np.maximum(end[None, :n] - 1 - t - np.arange(steps)[:, None], 0)]]  # past a lane's begin: unused
        f, start = fs & 0xFFFF, fs >> 16
        most, gain, inv, right = (f << 19) - 1, SCALE - f, inverse[f], bits[f]
        was = np.full((steps, 2, n), -1, np.int64)
        for k in range(steps):
            m = live[t]
            if m < FEW:
                break
            x, r, top = state[:m], room[:m], most[k, :m]
            for turn in (0, 1):  # a symbol sends two bytes at most
                was[k, turn, :m] = x
                np.subtract(top, x, out=r)
                r >>= 63
                r &= 8
                x >>= r
            np.multiply(x, inv[k, :m], out=r)
            r >>= right[k, :m]
            r *= gain[k, :m]
            x += r
            x += start[k, :m]
            t += 1
        sent = (was > most[:, None, :]).transpose(2, 0, 1).reshape(n, -1)
        put = was.astype(np.uint8).transpose(2, 0, 1).reshape(n, -1)
        flat, cuts = put[sent].tobytes(), np.append(0, np.cumsum(sent.sum(axis=1))).tolist()
        for lane in range(n):
            out[lane].append(flat[cuts[lane] : cuts[lane + 1]])
    for lane in range(live[t] if t < longest else 0):  # the few that are longer
        f, c, x, own = freq[lane].tolist(), first[lane].tolist(), int(state[lane]), bytearray()
        for s in data[end[lane] - size[lane] : end[lane] - t][::-1].tolist():
            limit = f[s] << 19
            while x >= limit:
                own.append(x & 255)
                x >>= 8
            x = (x // f[s] << BITS) + x % f[s] + c[s]
        state[lane] = x
        out[lane].append(bytes(own))
    return state, [b"".join(x)[::-1] for x in out]


def compress_many(blocks: list[bytes]) -> list[bytes]:
    """``entropy.compress`` of each block."""
    raw = [b"\0" + struct.pack("<I", len(b)) + b for b in blocks]
    order = sorted((k for k, b in enumerate(blocks) if b), key=lambda k: -len(blocks[k]))
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        data = np.frombuffer(b"".join(blocks[k] for k in own), np.uint8)
        size = np.array([len(blocks[k]) for k in own])
        ends = np.cumsum(size)
        freq = normalised_many(_counts(data, np.append(0, ends)))
        heads, head_at = _heads(freq)
        state, out = _encode(data, ends, size, freq)
        used = np.count_nonzero(freq, axis=1).tolist()
        for k, u, h, i, x, body in zip(own, used, head_at[:-1].tolist(), head_at[1:].tolist(), state.tolist(), out, strict=True):
            if 15 + i - h + len(body) < len(raw[k]):
                raw[k] = b"\2" + struct.pack("<IH", len(blocks[k]), u) + heads[h:i].tobytes() + struct.pack("<II", len(body) + 4, x) + body
    return raw


def _models(blocks: list[bytes], most: int) -> tuple[np.ndarray, ...]:
    """(sound, size, frequencies, where the body begins, state) of coded blocks; what is not sound is not looked at further."""
    length = np.array([len(b) for b in blocks], np.int64)
    begin = np.cumsum(length) - length
    stop = begin + length
    raw = np.frombuffer(b"".join(blocks) + bytes(600), np.uint8).astype(np.int64)
    word = lambda at, n: sum(raw[np.minimum(at + k, len(raw) - 1)] << 8 * k for k in range(n))
    size, used = word(begin + 1, 4), word(begin + 5, 2)
    sound = (length >= 15) & (raw[begin] == 2) & (size > 0) & (size <= most) & (used >= 1) & (used <= 256)
    freq, at = np.zeros((len(blocks), 256), np.int64), begin + 7
    for k in range(int(used[sound].max(initial=0))):
        i = np.flatnonzero(sound & (used > k))
        here = np.minimum(at[i], len(raw) - 3)
        symbol, f, more = raw[here], raw[here + 1], raw[here + 2]
        long = f >= 128
        value = np.where(long, f + (more << 7) - 128, f)
        fine = (value > 0) & (value <= SCALE) & (~long | (more > 0) & (more < 128)) & (freq[i, symbol] == 0)
        sound[i] &= fine
        freq[i, symbol] = value
        at[i] = here + 2 + long
    coded, state = word(at, 4), word(at + 4, 4)
    sound &= (freq.sum(axis=1) == SCALE) & (coded >= 4) & (at + 4 + coded == stop) & (state >= LOW)
    return sound, size, freq, at + 8 - begin, state


def decompress_many(blocks: list[bytes], most: int) -> list[bytes | Rejected]:
    """``entropy.decompress`` of each block, or its rejection."""
    out: list[bytes | Rejected | None] = [None] * len(blocks)
    coded = [k for k, b in enumerate(blocks) if b[:1] == b"\2"]
    for lo in range(0, len(coded), 16 * LANES):
        part = coded[lo : lo + 16 * LANES]
        sound, size, freq, body, state = _models([blocks[k] for k in part], most)
        order = np.flatnonzero(sound)
        order = order[np.argsort(-size[order], kind="stable")]
        for i in range(0, len(order), LANES):
            own = order[i : i + LANES]
            for k, x in zip(own.tolist(), _decode([blocks[part[k]] for k in own], size[own], freq[own], body[own], state[own]), strict=True):
                out[part[k]] = x
    for k, x in enumerate(out):
        if x is None:
            try:
                out[k] = entropy.decompress(blocks[k], most)
            except Rejected as e:
                out[k] = e
    return out


def _decode(blocks: list[bytes], size: np.ndarray, freq: np.ndarray, at: np.ndarray, state: np.ndarray) -> list[bytes | None]:
    """Lanes by descending size; None where the body does not end where it should. A state is above 2**11 after a symbol, so two bytes bring it back."""
    n = len(blocks)
    first = np.cumsum(freq, axis=1) - freq
    symbol = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), freq.ravel())  # SCALE slots a lane
    table = (freq | first << 16).ravel()
    length = np.array([len(b) for b in blocks])
    stop = np.cumsum(length)
    at = stop - length + at
    body = np.frombuffer(b"".join(blocks) + bytes(16), np.uint8).astype(np.int64)
    longest = int(size[0])
    lane, slot = np.arange(n) * 256, np.arange(n) * SCALE
    live = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    low, spot, own, mask, left = (np.empty(n, np.int64) for _ in range(5))
    texts: list[list[bytes]] = [[] for _ in range(n)]
    t = 0
    while t < longest and (width := live[t]) >= FEW:
        got = np.zeros((min(STEPS, longest - t), width), np.uint8)
        for row in got:
            m = live[t]
            if m < FEW:
                break
            x, lo, i, g, v, u, p = state[:m], low[:m], spot[:m], own[:m], mask[:m], left[:m], at[:m]
            np.bitwise_and(x, SCALE - 1, out=lo)
            np.add(slot[:m], lo, out=i)
            symbol.take(i, out=row[:m], mode="clip")
            np.add(lane[:m], row[:m], out=i)
            table.take(i, out=g, mode="clip")
            np.bitwise_and(g, 0xFFFF, out=v)
            x >>= BITS
            x *= v
            g >>= 16
            lo -= g
            x += lo
            for _ in range(2):
                np.subtract(x, LOW, out=v)
                v >>= 63  # -1 where a byte is due
                np.bitwise_and(v, 8, out=u)
                x <<= u
                body.take(p, out=g, mode="clip")
                g &= v
                x |= g
                p -= v
            t += 1
        flat = np.ascontiguousarray(got.T)
        for k in range(width):
            texts[k].append(flat[k].tobytes())
    m = live[t] if t < longest else 0
    short = set()
    data = b"".join(blocks) if m else b""
    for k in range(m):  # the few that are longer
        f, c, x, p, end, own = freq[k].tolist(), first[k].tolist(), int(state[k]), int(at[k]), int(stop[k]), symbol[k * SCALE : (k + 1) * SCALE].tolist()
        rest = bytearray(int(size[k]) - t)
        for i in range(len(rest)):
            y = x & SCALE - 1
            s = rest[i] = own[y]
            x = f[s] * (x >> BITS) + y - c[s]
            while x < LOW and p < end:
                x = x << 8 | data[p]
                p += 1
            if x < LOW:
                short.add(k)
                break
        at[k] = p
        texts[k] = [b"".join(texts[k])[:t], bytes(rest)]
    return [None if k in short or a != b else b"".join(x)[:z] for k, (a, b, x, z) in enumerate(zip(at.tolist(), stop.tolist(), texts, size.tolist(), strict=True))]
