"""Intra prediction and mode decision of all blocks of an anti-diagonal at once, over the three planes of a frame together.

A block needs only what is reconstructed to its left and above, so the blocks of one anti-diagonal do not need each other. The one thing that a
decision takes from all blocks before it in raster order, whether a reference has been used, is guessed and held against the
outcome: the blocks up to the first wrong guess are right, so with the outcome as the next guess more of them are, until all agree.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

BLOCK, SIZE = 8, 64


def wht(x: np.ndarray) -> np.ndarray:
    """Forward transform of (n, 64), in six steps of sums and differences; the inverse is the same, divided by 64."""
    y = x.astype(np.int64)
    for step in (1, 2, 4, 8, 16, 32):
        z = np.empty_like(y)
        a, b = y.reshape(-1, 2, step), z.reshape(-1, 2, step)
        np.add(a[:, 0], a[:, 1], out=b[:, 0])
        np.subtract(a[:, 0], a[:, 1], out=b[:, 1])
        y = z
    return y


def div_round(v: np.ndarray, d: int) -> np.ndarray:
    """Nearest, halves away from zero."""
    return np.sign(v) * ((np.abs(v) + d // 2) // d)


def signed_lens(v: np.ndarray) -> np.ndarray:
    """Bytes of each value as a signed varint."""
    z = (v << 1) ^ (v >> 63)
    return 1 + (z >> 7 > 0) + (z >> 14 > 0) + (z >> 21 > 0) + (z >> 28 > 0)


def raw_rates(q: np.ndarray) -> np.ndarray:
    """Bytes of the tokens of rows of coefficients before entropy coding, with the mode's; indexes and counts take one."""
    return 2 + ((1 + signed_lens(q)) * (q != 0)).sum(axis=1)


@dataclass
class Near:
    """Where the blocks of a diagonal stand in the flat reconstruction, and what is next to them."""

    blocks: np.ndarray
    own: np.ndarray
    left: np.ndarray
    top: np.ndarray
    has_left: np.ndarray
    has_top: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    count: np.ndarray


class Layout:
    """The blocks of planes (height, width) in raster order, one plane after the other, each plane padded to whole blocks."""

    def __init__(self, shapes: tuple[tuple[int, int], ...]):
        self.shapes = shapes
        k = np.arange(BLOCK)
        self.first, at, parts = [0], 0, []
        self.spans = []
        for h, w in self.shapes:
            nx, ny = -(-w // BLOCK), -(-h // BLOCK)
            stride = nx * BLOCK
            bx, by = np.tile(np.arange(nx), ny), np.repeat(np.arange(ny), nx)
            origin = at + by * BLOCK * stride + bx * BLOCK
            parts.append((bx, by, np.minimum(BLOCK, w - bx * BLOCK), np.minimum(BLOCK, h - by * BLOCK), origin, np.full(nx * ny, stride)))
            self.spans.append((at, ny * BLOCK, stride))
            at += stride * ny * BLOCK
            self.first.append(self.first[-1] + nx * ny)
        self.samples, self.count = at, self.first[-1]
        bx, by, self.bw, self.bh, origin, stride = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.x, self.y = bx * BLOCK, by * BLOCK
        self.own = (origin[:, None, None] + k[:, None] * stride[:, None, None] + k).reshape(-1, SIZE)
        rows, columns = k < self.bh[:, None], k < self.bw[:, None]
        self.inside = (rows[:, :, None] & columns[:, None, :]).reshape(-1, SIZE)
        self.order = np.concatenate([np.arange(b - a) for a, b in zip(self.first[:-1], self.first[1:], strict=True)])
        self.plane = np.repeat(np.arange(len(shapes)), np.diff(self.first))
        left = np.maximum(origin[:, None] - 1 + k * stride[:, None], 0)
        top = np.maximum((origin - stride)[:, None] + k, 0)
        has_left, has_top = bx > 0, by > 0
        count = self.bw * has_top + self.bh * has_left
        near = lambda b: Near(b, self.own[b], left[b], top[b], has_left[b], has_top[b], rows[b] & has_left[b, None], columns[b] & has_top[b, None], count[b])
        diagonal = bx + by
        by_diagonal = np.argsort(diagonal, kind="stable")
        cuts = np.searchsorted(diagonal[by_diagonal], np.arange(diagonal.max() + 2))
        self.every = near(np.arange(self.count))
        self.diagonals = [near(np.sort(by_diagonal[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.near = near

    def flat(self, planes: list[np.ndarray], fill: int = 0) -> np.ndarray:
        """Planes as one flat array, padded to whole blocks."""
        out = np.full(self.samples, fill, np.int64)
        for (at, h, w), p in zip(self.spans, planes, strict=True):
            out[at : at + h * w].reshape(h, w)[: p.shape[0], : p.shape[1]] = p
        return out

    def planes(self, flat: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(flat[at : at + h * w].reshape(h, w)[: s[0], : s[1]]).astype(np.uint8) for (at, h, w), s in zip(self.spans, self.shapes, strict=True)]


@functools.lru_cache(maxsize=16)
def layout(*shapes: tuple[int, int]) -> Layout:
    return Layout(shapes)


def guesses(recon: np.ndarray, n: Near) -> np.ndarray:
    """(3, blocks, 8, 8): the mean of what is near, the samples to the left, those above; 128 where there are none."""
    left, top = recon[n.left], recon[n.top]
    total = (left * n.rows).sum(axis=1) + (top * n.columns).sum(axis=1)
    out = np.empty((3, len(n.blocks), BLOCK, BLOCK), np.int64)
    out[0] = np.where(n.count > 0, (total + n.count // 2) // np.maximum(n.count, 1), 128)[:, None, None]
    out[1] = np.where(n.has_left[:, None], left, 128)[:, :, None]
    out[2] = np.where(n.has_top[:, None], top, 128)[:, None, :]
    return out


def rebuild(lay: Layout, recon: np.ndarray, modes: np.ndarray, residual: np.ndarray) -> None:
    """Fill in the intra blocks (modes 0 to 2) of a reconstruction whose other blocks are there."""
    intra = modes < 3
    whole = intra.all()
    for n in lay.diagonals:
        if not whole:
            mine = n.blocks[intra[n.blocks]]
            if not len(mine):
                continue
            if len(mine) < len(n.blocks):
                n = lay.near(mine)
        g = guesses(recon, n)
        picked = g[modes[n.blocks], np.arange(len(n.blocks))].reshape(-1, SIZE)
        recon[n.own] = (picked + residual[n.blocks]).clip(0, 255)


def residuals(diff: np.ndarray, pred: np.ndarray, tiles: np.ndarray, inside: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared error, rate, coefficients, reconstruction) of blocks coded with the given predictions."""
    coded = div_round(wht(diff), q)
    got = (pred + div_round(wht(coded * q), SIZE)).clip(0, 255)
    err = (((tiles - got) ** 2) * inside).sum(axis=1)
    return err, raw_rates(coded), coded, got


@dataclass
class Inter:
    """What all blocks would be from other frames: by block sad, reference, motion, error, rate, coefficients, reconstruction."""

    sad: np.ndarray
    ref: np.ndarray
    dx2: np.ndarray
    dy2: np.ndarray
    err: np.ndarray
    rate: np.ndarray
    coded: np.ndarray
    got: np.ndarray


@dataclass
class Chosen:
    mode: np.ndarray
    coded: np.ndarray
    recon: np.ndarray


def decide(lay: Layout, tiles: np.ndarray, inter: Inter | None, colors: np.ndarray, q: int, preset: str, refs: int) -> Chosen:
    """The mode of every block, its coefficients, and the reconstruction. ``colors``: how many a palette of the block would have, 0 for none.

    ``tiles`` are the source blocks, 0 outside the planes.
    """
    lam = max(q * q // 512, 1)
    never = lay.count
    used = np.full((3, max(refs, 1)), never)  # the first block of each plane that uses a reference
    if inter is not None:
        source = np.zeros(lay.samples, np.int64)
        source[lay.own.ravel()] = tiles.ravel()
        sad = np.abs(tiles - guesses(source, lay.every).reshape(3, -1, SIZE) * lay.inside).sum(axis=2).min(axis=0)
        used = _first_uses(lay, inter.sad < sad, inter, refs)
    while True:
        out = _pass(lay, tiles, inter, colors, q, lam, preset, used)
        if inter is None or preset == "fast":
            return out
        found = _first_uses(lay, out.mode == 3, inter, refs)
        if (found == used).all():
            return out
        used = found


def _first_uses(lay: Layout, taken: np.ndarray, inter: Inter, refs: int) -> np.ndarray:
    out = np.full((3, max(refs, 1)), lay.count)
    at = np.flatnonzero(taken)
    np.minimum.at(out, (lay.plane[at], inter.ref[at]), lay.order[at])
    return out


def _pass(lay: Layout, tiles: np.ndarray, inter: Inter | None, colors: np.ndarray, q: int, lam: int, preset: str, used: np.ndarray) -> Chosen:
    recon = np.full(lay.samples, 128, np.int64)
    mode, coded = np.zeros(lay.count, np.int64), np.zeros((lay.count, SIZE), np.int64)
    area = lay.bw * lay.bh
    palette_cost = np.where(colors > 0, lam * (3 + colors + -(-area // 4)), np.iinfo(np.int64).max)
    fresh = 0 if inter is None else 8 * (lay.order <= used[lay.plane, inter.ref])
    inter_score = None if inter is None else inter.err + lam * (inter.rate + fresh)
    for n in lay.diagonals:
        b = n.blocks
        t, inside = tiles[b], lay.inside[b]
        g = guesses(recon, n).reshape(3, -1, SIZE) * inside
        sads = np.abs(t - g).sum(axis=2)
        m = sads.argmin(axis=0)
        sad = sads.min(axis=0)
        pred = g[m, np.arange(len(b))]
        err, rate, flat, got = residuals(t - pred, pred, t, inside, q)
        if inter is not None:
            before = inter.sad[b] < sad
            if preset == "fast":
                swap = before
            else:
                own, other = err + lam * rate, inter_score[b]
                both = np.ones(len(b), bool) if q == 1 or preset == "quality" else np.abs(sad - inter.sad[b]) <= 2 * q
                swap = np.where(before, ~(both & (own < other)), both & (other < own))  # another form wins only if strictly better
            m = np.where(swap, 3, m)
            flat = np.where(swap[:, None], inter.coded[b], flat)
            got = np.where(swap[:, None], inter.got[b], got)
        if colors.any():
            if preset == "fast":
                least = sad if inter is None else np.minimum(sad, inter.sad[b])
                few = (colors[b] > 0) & (least > 4 * area[b])
            else:
                best = err + lam * rate if inter is None else np.where(swap, inter_score[b], err + lam * rate)
                few = palette_cost[b] < best
            m = np.where(few, 4, m)
            got = np.where(few[:, None], t, got)
        recon[n.own] = got
        mode[b], coded[b] = m, flat
    return Chosen(mode, coded, recon)


def varints(block: np.ndarray, order: np.ndarray, value: np.ndarray, raw: np.ndarray, blocks: int) -> tuple[bytes, np.ndarray]:
    """Values as unsigned varints (``raw`` ones as single bytes) by block, then order, and where each block's bytes begin, with the end."""
    o = np.lexsort((order, block))
    block, value, raw = block[o], value[o], raw[o]
    size = np.where(raw, 1, 1 + (value >> 7 > 0) + (value >> 14 > 0) + (value >> 21 > 0) + (value >> 28 > 0))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > k)
        v = value[i] >> 7 * k
        out[at[i] + k] = np.where(raw[i], value[i], v & 127 | np.where(size[i] > k + 1, 128, 0))
    return out.tobytes(), np.append(0, np.cumsum(np.bincount(block, size, blocks).astype(np.int64)))
