"""Format experiments over clips: what a syntax change would cost or save, measured on predictions alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import entropy
from .audio import div_round
from .video import inverse_wht, palette, wht


def _varint_len(v: int) -> int:
    return max(1, -(-v.bit_length() // 7))


def _signed_len(v: int) -> int:
    return _varint_len((v << 1) ^ (v >> 63))


#: Extra absolute difference a sample that a merged vector may cost, and edge thresholds of the filter.
MERGE_LIMITS, EDGES = (0, 1, 2, 4), (2, 4, 8, 16, 32)


def tiles(plane: np.ndarray, n: int = 8) -> np.ndarray:
    """Whole n x n blocks in raster order, as integers; partial ones are left out."""
    h, w = (d - d % n for d in plane.shape)
    return plane[:h, :w].astype(np.int64).reshape(h // n, n, w // n, n).swapaxes(1, 2).reshape(-1, n, n)


def token_cost(blocks: np.ndarray) -> int:
    """Sparse token bytes of (n, 64) coefficients."""
    nonzero = (blocks != 0).sum(axis=1)
    at, value = np.nonzero(blocks)[1], blocks[blocks != 0]
    return sum(map(_varint_len, nonzero.tolist())) + sum(map(_varint_len, at.tolist())) + sum(map(_signed_len, value.tolist()))


def transform_skip(luma: list[np.ndarray], q: int) -> dict:
    """Tokens of frame differences with the transform at step q, and without it at the step of 1..32 whose distortion is nearest."""
    r = np.concatenate([tiles(b.astype(np.int64) - a) for a, b in zip(luma, luma[1:], strict=False)] or [np.zeros((0, 8, 8), np.int64)])
    coded = div_round(wht(r), q)
    target = int(((r - inverse_wht(coded * q)) ** 2).sum())
    flat = r.reshape(-1, 64)
    gap, step = min((abs(int(((flat - div_round(flat, s) * s) ** 2).sum()) - target), s) for s in range(1, 33))
    skip = div_round(flat, step)
    return {"blocks": len(r), "bytes": token_cost(coded.reshape(-1, 64)), "sse": target, "skip_step": step, "skip_bytes": token_cost(skip), "skip_sse": int(((flat - skip * step) ** 2).sum()), "gap": gap}


def block_copy(luma: np.ndarray) -> dict:
    """Blocks that repeat the bytes of an earlier one of their frame; for those of few colours, palette bytes against offset bytes."""
    t = tiles(luma)
    across = luma.shape[1] // 8
    seen: dict[bytes, int] = {}
    out = dict.fromkeys(("blocks", "repeated", "palette_repeated", "palette_bytes", "copy_bytes"), 0)
    out["blocks"] = len(t)
    for i, b in enumerate(t):
        first = seen.setdefault(b.astype(np.uint8).tobytes(), i)
        if first == i:
            continue
        out["repeated"] += 1
        colors = palette(b.astype(np.uint8))
        if colors:
            out["palette_repeated"] += 1
            out["palette_bytes"] += 2 + len(colors[0]) + 16
            out["copy_bytes"] += _signed_len(first % across - i % across) + _signed_len(first // across - i // across)
    return out


def _grids(cur: np.ndarray, ref: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(sad, vector) of each whole block over whole-sample displacements that stay inside the frame, ties to the first in scan order."""
    h, w = cur.shape
    t = tiles(cur, n)
    ys, xs = np.divmod(np.arange(len(t)), w // n)
    best, vec = np.full(len(t), np.iinfo(np.int64).max), np.zeros((len(t), 2), np.int64)
    k, r = np.arange(n), ref.astype(np.int64)
    steps = sorted(((dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)), key=lambda s: s != (0, 0))
    for dy, dx in steps:
        y, x = ys * n + dy, xs * n + dx
        ok = np.flatnonzero((y >= 0) & (x >= 0) & (y + n <= h) & (x + n <= w))
        s = np.abs(t[ok] - r[(y[ok, None] + k)[:, :, None], (x[ok, None] + k)[:, None, :]]).sum(axis=(1, 2))
        better = s < best[ok]
        best[ok[better]], vec[ok[better]] = s[better], (dx, dy)
    return best, vec


def motion_merge(luma: list[np.ndarray], radius: int = 2) -> dict:
    """16x16 groups: bytes of four vectors, of a modal vector with corrections, and of one vector where it costs little."""
    out: dict = {"groups": 0, "bytes": 0, "lattice_bytes": 0, "corrected": 0}
    merged: list[tuple[int, int, int, int]] = []
    vector = lambda v: _signed_len(2 * int(v[0])) + _signed_len(2 * int(v[1]))
    for a, b in zip(luma, luma[1:], strict=False):
        h, w = b.shape
        small, sv = _grids(b, a, 8, radius)
        large, lv = _grids(b, a, 16, radius)
        for g in range(len(large)):
            y, x = divmod(g, w // 16)
            own = [(2 * y + j) * (w // 8) + 2 * x + i for j in (0, 1) for i in (0, 1)]
            vs = [tuple(sv[o].tolist()) for o in own]
            before = sum(map(vector, vs))
            base = max(dict.fromkeys(vs), key=lambda v: (vs.count(v), -abs(v[0]) - abs(v[1])))
            rest = [v for v in vs if v != base]
            out["groups"] += 1
            out["bytes"] += before
            out["lattice_bytes"] += vector(base) + 1 + sum(vector((v[0] - base[0], v[1] - base[1])) for v in rest)
            out["corrected"] += bool(rest)
            merged.append((int(small[own].sum()), int(large[g]), before, vector(lv[g])))
    for limit in MERGE_LIMITS:
        ok = [m for m in merged if m[1] - m[0] <= limit * 256]
        out |= {f"accepted_{limit}": len(ok), f"saved_{limit}": sum(m[2] - m[3] for m in ok)}
    return out


def deblock(source: list[np.ndarray], decoded: list[np.ndarray]) -> dict:
    """Luma error before and after a [3, 1] / 4 filter of block edges whose step is within a threshold: columns first, then rows."""
    error = lambda frames: sum(int(((a.astype(np.int64) - b) ** 2).sum()) for a, b in zip(source, frames, strict=True))

    def columns(f: np.ndarray, limit: int) -> np.ndarray:
        f = f.copy()
        right = np.arange(8, f.shape[1], 8)
        a, b = f[:, right - 1], f[:, right]
        near = np.abs(a - b) <= limit
        f[:, right - 1], f[:, right] = np.where(near, (3 * a + b + 2) // 4, a), np.where(near, (a + 3 * b + 2) // 4, b)
        return f

    wide = [d.astype(np.int64) for d in decoded]
    return {"sse": error(wide)} | {f"sse_{t}": error([columns(columns(f, t).T, t).T for f in wide]) for t in EDGES}


def entropy_lanes(data: bytes) -> dict:
    """One entropy block against two of the even and the odd bytes."""
    return {"one_block": len(entropy.compress(data)), "two_lanes": len(entropy.compress(data[::2])) + len(entropy.compress(data[1::2]))}


def experiments(frames: DataFrame, q: int = 48) -> DataFrame:
    """(clip_id, experiment, measure, value) over all frames of clips (clip_id, frame_index, width, height, y); one task a clip."""
    from .video import Encoder, Frame

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["frame_index"])
        luma = [np.frombuffer(r["y"], np.uint8).reshape(r["height"], r["width"]) for r in rows]
        enc = Encoder(q, "fast")
        decoded = [enc.encode(i, Frame.of(r["width"], r["height"], r["y"], r["u"], r["v"]))[1].planes[0] for i, r in enumerate(rows)]
        every = lambda found: {k: sum(x[k] for x in found) for k in found[0]}
        found = {"transform_skip": transform_skip(luma, q), "block_copy": every([block_copy(x) for x in luma]), "motion_merge": motion_merge(luma), "deblock": deblock(luma, decoded), "entropy_lanes": every([entropy_lanes(r["y"]) for r in rows])}
        flat = [(rows[0]["clip_id"], e, m, int(v)) for e, d in found.items() for m, v in d.items()]
        return pa.table([pa.array(c) for c in zip(*flat, strict=True)], names=["clip_id", "experiment", "measure", "value"])

    return frames.groupBy("clip_id").applyInArrow(run, "clip_id string, experiment string, measure string, value long")
