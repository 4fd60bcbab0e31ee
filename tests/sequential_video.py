"""The frame encoder block by block in raster order, as the wavefront's second form: what its payloads are held against."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessera.operators.audio import div_round, tokens
from tessera.operators.entropy import compress, put_svarint
from tessera.operators.video import _HEAD, BLOCK, MAGIC, PRESETS, Frame, HalfSamples, Retained, _grid, _search, palette

_H = np.array([[1]])
for _ in range(3):
    _H = np.block([[_H, _H], [_H, -_H]])


def wht(x):
    return _H @ x @ _H


def inverse_wht(q):
    return div_round(wht(q), 64)


def intra(recon: np.ndarray, x: int, y: int, bw: int, bh: int, mode: int) -> np.ndarray | int:
    """Prediction of a block from what is reconstructed above and to the left; broadcasts to (bh, bw)."""
    if mode == 1:
        return recon[y : y + bh, x - 1 : x] if x else 128
    if mode == 2:
        return recon[y - 1 : y, x : x + bw] if y else 128
    near = (recon[y - 1, x : x + bw] if y else recon[:0, 0], recon[y : y + bh, x - 1] if x else recon[:0, 0])
    n = len(near[0]) + len(near[1])
    return (int(near[0].sum()) + int(near[1].sum()) + n // 2) // n if n else 128


@dataclass
class Block:
    mode: int
    ref: int = 0
    dx2: int = 0
    dy2: int = 0
    q: np.ndarray | None = None
    colors: list[int] | None = None
    index: np.ndarray | None = None


def _signed_lens(v: np.ndarray) -> np.ndarray:
    """Bytes of each value as a signed varint."""
    z = (v << 1) ^ (v >> 63)
    return 1 + (z >> 7 > 0) + (z >> 14 > 0) + (z >> 21 > 0) + (z >> 28 > 0)


def raw_rates(q: np.ndarray) -> np.ndarray:
    """Bytes of the tokens of rows of coefficients before entropy coding, with the mode's; indexes and counts take one."""
    return 2 + ((1 + _signed_lens(q)) * (q != 0)).sum(axis=1)


def _residuals(diff: np.ndarray, pred: np.ndarray, tiles: np.ndarray, inside: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared error, rate, coefficients, reconstruction) of blocks coded with the given predictions."""
    coded = div_round(wht(diff), q)
    got = (pred + inverse_wht(coded * q)).clip(0, 255)
    err = (((tiles - got) ** 2) * inside).reshape(len(got), -1).sum(axis=1)
    flat = coded.reshape(-1, 64)
    return err, raw_rates(flat), flat, got


def _encode_plane(src: np.ndarray, refs: list[HalfSamples], q: int, preset: str, use_palette: bool) -> tuple[list[Block], list[bool], np.ndarray]:
    """Blocks in raster order, which references they use, and the reconstruction.

    What comes from other frames needs nothing of this one, so it is searched and coded for all blocks at once; only
    intra prediction goes block by block.
    """
    h, w = src.shape
    grid = _grid(h, w)
    at = np.array([g[:2] for g in grid])
    padded = np.pad(src.astype(np.int64), ((0, -h % BLOCK), (0, -w % BLOCK)))
    tiles = padded.reshape(padded.shape[0] // BLOCK, BLOCK, -1, BLOCK).swapaxes(1, 2).reshape(-1, BLOCK, BLOCK)
    k = np.arange(BLOCK)
    inside = ((at[:, 1, None] + k < h)[:, :, None]) & ((at[:, 0, None] + k < w)[:, None, :])
    lam, recon, used, out = max(q * q // 512, 1), np.full((h, w), 128, np.int64), [False] * len(refs), []

    if refs:
        found = [_search(src.astype(np.int16), tiles, inside, at, r, PRESETS[preset][0], preset == "fast") for r in refs]
        which = np.argmin(np.stack([f[0] for f in found]), axis=0)  # the first of equals
        sad, dx2, dy2 = (np.choose(which, [f[j] for f in found]) for j in range(3))
        pred = np.zeros((len(grid), BLOCK, BLOCK), np.int64)
        for r, ref in enumerate(refs):
            own = np.flatnonzero(which == r)
            pred[own] = ref.at(at[own, 0], at[own, 1], dx2[own], dy2[own])
        errs, rates, flats, gots = _residuals((tiles - pred) * inside, pred, tiles, inside, q)
        rates = rates + 1 + _signed_lens(dx2) + _signed_lens(dy2)
        inter = list(zip(sad.tolist(), which.tolist(), dx2.tolist(), dy2.tolist(), errs.tolist(), rates.tolist(), strict=True))
    ordered = np.sort(tiles.reshape(len(grid), -1), axis=1)
    few = ((ordered[:, 1:] != ordered[:, :-1]).sum(axis=1) <= 4) | ~inside.all(axis=(1, 2))  # the rest have more than four colours

    def as_inter(i: int):
        _, r, x2, y2, err, rate = inter[i]
        return err, rate, Block(3, r, x2, y2, flats[i]), gots[i, : grid[i][3], : grid[i][2]]

    def as_intra(i: int, mode: int, p):
        _, _, bw, bh = grid[i]
        here, wide = inside[i : i + 1], np.zeros((1, BLOCK, BLOCK), np.int64)
        wide[0, :bh, :bw] = p
        err, rate, flat, got = _residuals((tiles[i : i + 1] - wide) * here, wide, tiles[i : i + 1], here, q)
        return int(err[0]), int(rate[0]), Block(mode, 0, 0, 0, flat[0]), got[0, :bh, :bw]

    for i, (x, y, bw, bh) in enumerate(grid):
        here = tiles[i, :bh, :bw]
        guesses = [intra(recon, x, y, bw, bh, m) for m in (0, 1, 2)]
        intra_sad, intra_mode = min((int(np.abs(here - p).sum()), m) for m, p in enumerate(guesses))
        inter_sad = inter[i][0] if refs else None
        inter_first = inter_sad is not None and inter_sad < intra_sad
        colors = palette(src[y : y + bh, x : x + bw]) if use_palette and few[i] else None
        err, rate, chosen, got = as_inter(i) if inter_first else as_intra(i, intra_mode, guesses[intra_mode])
        if preset == "fast":
            if colors and min(intra_sad, intra_sad if inter_sad is None else inter_sad) > 4 * bw * bh:
                chosen, got = Block(4, colors=colors[0], index=colors[1]), here
        else:
            def score(e: int, n: int, b: Block) -> int:
                return e + lam * (n + (8 if b.mode == 3 and not used[b.ref] else 0))

            best = score(err, rate, chosen)
            if inter_sad is not None and (q == 1 or preset == "quality" or abs(intra_sad - inter_sad) <= 2 * q):
                err, rate, b, g = as_intra(i, intra_mode, guesses[intra_mode]) if inter_first else as_inter(i)
                if score(err, rate, b) < best:
                    best, chosen, got = score(err, rate, b), b, g
            if colors and lam * (3 + len(colors[0]) + -(-bw * bh // 4)) < best:
                chosen, got = Block(4, colors=colors[0], index=colors[1]), here
        if chosen.mode == 3:
            used[chosen.ref] = True
        recon[y : y + bh, x : x + bw] = got
        out.append(chosen)
    return out, used, recon.astype(np.uint8)


def _serialise(blocks: list[Block], place: dict[int, int]) -> tuple[bytes, bytes]:
    """(mode bytes, everything else)."""
    control, data, mixed = bytearray(), bytearray(), bytearray()
    for b in blocks:
        at = len(data)
        if b.mode == 4:
            data += bytes([len(b.colors), *b.colors, len(b.index)])
            padded = np.pad(b.index, (0, -len(b.index) % 4)).reshape(-1, 4)
            data += (padded << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8).tobytes()
        else:
            if b.mode == 3:
                data.append(place[b.ref])
                put_svarint(b.dx2, data)
                put_svarint(b.dy2, data)
            tokens(b.q[None, :], data)
        control.append(b.mode)
        mixed += bytes([b.mode]) + data[at:]
    return bytes(mixed), (bytes(control), bytes(data))


def encode(frame_id, frame, references, q, preset, use_palette=True):
    width, height = frame.size
    references = [r for r in references if r[1].size == frame.size][: PRESETS[preset][1]]
    coded = [_encode_plane(frame.planes[i], [HalfSamples(r.planes[i]) for _, r in references], q, preset, use_palette) for i in range(3)]
    needed = [k for k in range(len(references)) if any(used[k] for _, used, _ in coded)]
    place = {k: n for n, k in enumerate(needed)}
    deps = [references[k][0] for k in needed]
    out = bytearray(_HEAD.pack(MAGIC, frame_id, width, height, q, len(deps), 1) + struct.pack(f"<{len(deps)}Q", *deps))
    for blocks, _, _ in coded:
        mixed, split = _serialise(blocks, place)
        one, two = compress(mixed), [compress(s) for s in split]
        layout, parts = (0, [one]) if 4 + len(one) <= 8 + sum(map(len, two)) else (1, two)
        out.append(layout)
        for p in parts:
            out += struct.pack("<I", len(p)) + p
    return bytes(out), Frame(tuple(r for _, _, r in coded)), deps


class Encoder:
    def __init__(self, q, preset):
        self.options, self.kept = (q, preset), Retained()

    def encode(self, frame_id, frame):
        out = encode(frame_id, frame, list(reversed(self.kept.frames.items())), *self.options)
        self.kept.add(frame_id, out[1])
        return out
