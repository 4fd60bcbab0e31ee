"""Video frames: planar 4:2:0, 8x8 blocks, intra / half-sample inter / palette, Walsh-Hadamard residuals."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from . import lanes, wavefront
from .audio import div_round, read_sparse
from .entropy import Cursor, compress, decompress
from .errors import Rejected
from .wire import MAX_ENTROPY, MAX_PIXELS

#: Fixed values of the format.
MAGIC, BLOCK, MAX_SIDE, MAX_REFS, MAX_MOTION = b"ALV1", 8, 8192, 4, 64
MAX_COEFFICIENT, MAX_DEQUANTISED = 1_000_000, 33_554_431
#: (motion radius, references) of each preset.
PRESETS = {"fast": (2, 1), "balanced": (4, 1), "quality": (5, 4)}
#: Frames whose entropy blocks are coded at once, each block a lane.
TOGETHER = 64
_HEAD = struct.Struct("<4sQHHHBB")


@dataclass
class Frame:
    """Three planes of unsigned bytes; chroma has half the luma's width and height."""

    planes: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, width: int, height: int, y: bytes, u: bytes, v: bytes) -> Frame:
        check_size(width, height)
        sizes = [(height, width), (height // 2, width // 2), (height // 2, width // 2)]
        if [len(y), len(u), len(v)] != [a * b for a, b in sizes]:
            raise Rejected("PlaneLength")
        return cls(tuple(np.frombuffer(p, np.uint8).reshape(s) for p, s in zip((y, u, v), sizes, strict=True)))

    @property
    def size(self) -> tuple[int, int]:
        return self.planes[0].shape[1], self.planes[0].shape[0]


def check_size(width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE) or width % 2 or height % 2 or width * height > MAX_PIXELS:
        raise Rejected("BadDimensions")


def wht(x: np.ndarray) -> np.ndarray:
    """Forward transform of (n, 8, 8); the inverse is the same, divided by 64."""
    return wavefront.wht(x.reshape(-1, BLOCK * BLOCK)).reshape(x.shape)


def inverse_wht(q: np.ndarray) -> np.ndarray:
    return div_round(wht(q), 64)


class HalfSamples:
    """A plane at half-sample steps: the four interpolated planes by parity, their edges repeated as far as motion reaches."""

    MARGIN = MAX_MOTION // 2 + BLOCK

    def __init__(self, ref: np.ndarray):
        p = np.pad(ref.astype(np.int16), ((self.MARGIN, self.MARGIN + 1), (self.MARGIN, self.MARGIN + 1)), mode="edge")
        a, b, c, d = p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]
        self.planes = np.stack([a, a + b + 1 >> 1, a + c + 1 >> 1, a + b + c + d + 2 >> 2])
        self.flat = self.planes.ravel()
        _, self.rows, self.stride = self.planes.shape
        k = np.arange(BLOCK)
        self.inner = (k[:, None] * self.stride + k).ravel()

    def at(self, x0: np.ndarray, y0: np.ndarray, dx2: np.ndarray, dy2: np.ndarray) -> np.ndarray:
        """Predictions (n, 8, 8) of blocks at (x0, y0)."""
        parity = (dy2 & 1) * 2 + (dx2 & 1)
        first = (parity * self.rows + y0 + (dy2 >> 1) + self.MARGIN) * self.stride + x0 + (dx2 >> 1) + self.MARGIN
        return self.flat[first[:, None] + self.inner].reshape(-1, BLOCK, BLOCK)

    def shifted(self, dx: int, dy: int, h: int, w: int) -> np.ndarray:
        """The whole plane moved by whole samples."""
        return self.planes[0, self.MARGIN + dy : self.MARGIN + dy + h, self.MARGIN + dx : self.MARGIN + dx + w]


def motion(ref: np.ndarray, x0: np.ndarray, y0: np.ndarray, dx2: np.ndarray, dy2: np.ndarray) -> np.ndarray:
    """Half-sample predictions (n, 8, 8) of blocks at (x0, y0); coordinates clamp to the edges."""
    return HalfSamples(ref).at(x0, y0, dx2, dy2)


def _grid(h: int, w: int) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the blocks in raster order."""
    return [(x, y, min(BLOCK, w - x), min(BLOCK, h - y)) for y in range(0, h, BLOCK) for x in range(0, w, BLOCK)]


# --- decoding -------------------------------------------------------------------------------------------------------


@dataclass
class Header:
    frame_id: int
    width: int
    height: int
    q: int
    deps: list[int]
    body: int


def read_header(b: bytes) -> Header:
    if len(b) < _HEAD.size:
        raise Rejected("UnexpectedEof")
    magic, frame_id, width, height, q, deps, flags = _HEAD.unpack_from(b)
    if magic != MAGIC:
        raise Rejected("BadHeader")
    check_size(width, height)
    if q < 1:
        raise Rejected("BadQuantizer")
    if deps > MAX_REFS or flags != 1:
        raise Rejected("BadHeader")
    end = _HEAD.size + 8 * deps
    if len(b) < end:
        raise Rejected("UnexpectedEof")
    ids = list(struct.unpack_from(f"<{deps}Q", b, _HEAD.size))
    if len(set(ids)) != deps or frame_id in ids:
        raise Rejected("BadHeader")
    return Header(frame_id, width, height, q, ids, end)


def _envelopes(b: bytes, at: int, planes: int = 3) -> list[list[bytes]]:
    """The entropy blocks of the planes: one (mixed) or two (control, data) each."""
    out, c = [], Cursor(b)
    c.at = at
    for _ in range(planes):
        layout = c.byte()
        if layout > 1:
            raise Rejected("BadMode")
        out.append([c.take(struct.unpack("<I", c.take(4))[0]) for _ in range(layout + 1)])
    c.end()
    return out


def plane_bytes(b: bytes, at: int) -> list[bytes]:
    """Each plane's envelope as it stands in a payload."""
    sizes = [1 + sum(4 + len(x) for x in e) for e in _envelopes(b, at)]
    ends = np.cumsum([at, *sizes]).tolist()
    return [b[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def one_envelope(b: bytes, at: int) -> list[bytes]:
    """The entropy blocks of a payload that holds one plane alone."""
    return _envelopes(b, at, 1)[0]


@dataclass
class Parsed:
    """What a plane's entropy blocks say of each of its blocks."""

    modes: np.ndarray
    residual: np.ndarray
    moves: list[tuple[int, int, int, int]]
    palettes: dict[int, np.ndarray]


def _plain(data: bytes, control: bytes | None, n: int, refs: int) -> tuple[np.ndarray, np.ndarray, list] | None:
    """(modes, coefficients, moves) of a plane without palettes, which is varints throughout; None for any other and whatever is not in order."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw) or raw[-1] > 127:
        return None
    ends = np.flatnonzero(raw < 128)
    size = np.diff(ends, prepend=-1)
    if size.max() > 5 or ((size > 1) & (raw[ends] == 0)).any():
        return None
    value = raw[ends]
    for k in range(1, int(size.max())):
        i = size > k
        value[i] = value[i] << 7 | raw[ends[i] - k] & 127
    v, at, modes, begin, count, moves = value.tolist(), 0, list(control) if control is not None else [], [], [], []
    try:
        for k in range(n):
            if control is None:
                modes.append(v[at])
                at += 1
            if modes[k] == 3:
                r, dx, dy = v[at : at + 3]
                at += 3
                moves.append((k, r, (dx >> 1) ^ -(dx & 1), (dy >> 1) ^ -(dy & 1)))
            elif modes[k] > 3:
                return None
            count.append(v[at])
            begin.append(at + 1)
            at += 1 + 2 * v[at]
    except (IndexError, ValueError):
        return None
    if at != len(v) or len(modes) != n or max(count) > 64 or any(r >= refs or abs(dx) > MAX_MOTION or abs(dy) > MAX_MOTION for _, r, dx, dy in moves):
        return None
    n_, first = np.array(count), np.array(begin)
    block = np.repeat(np.arange(n), n_)
    place = first[block] + 2 * (np.arange(len(block)) - np.repeat(np.cumsum(n_) - n_, n_))
    index, z = value[place], value[place + 1]
    coefficient = (z >> 1) ^ -(z & 1)
    falls = (index[1:] <= index[:-1]) & (block[1:] == block[:-1])
    if (index > 63).any() or falls.any() or (z >> 32).any() or (np.abs(coefficient) > MAX_COEFFICIENT).any():
        return None
    out = np.zeros((n, 64), np.int64)
    out[block, index] = coefficient
    return np.array(modes), out, moves


def parse_plane(blocks: list[bytes], h: int, w: int, q: int, refs: int, inflate: Callable[[bytes], bytes]) -> Parsed:
    """Everything of a plane that needs no sample of another block or frame."""
    data = Cursor(inflate(blocks[-1]))
    control = Cursor(inflate(blocks[0])) if len(blocks) == 2 else data
    grid = _grid(h, w)
    if plain := _plain(data.data, control.data if len(blocks) == 2 else None, len(grid), refs):
        deq = plain[1] * q
        if np.abs(deq).max() > MAX_DEQUANTISED:
            raise Rejected("BadCoefficient")
        return Parsed(plain[0], inverse_wht(deq.reshape(-1, BLOCK, BLOCK)).reshape(-1, 64), plain[2], {})
    coefficients = [[0] * 64 for _ in grid]
    modes, moves, palettes = [], [], {}
    for k, (_, _, bw, bh) in enumerate(grid):
        mode = control.byte()
        modes.append(mode)
        if mode > 4:
            raise Rejected("BadMode")
        if mode == 4:
            n = data.byte()
            if not 1 <= n <= 4:
                raise Rejected("BadPalette")
            colors = np.frombuffer(data.take(n), np.uint8)
            if data.byte() != bw * bh:
                raise Rejected("BadPalette")
            packed = np.frombuffer(data.take(-(-bw * bh // 4)), np.uint8)
            index = ((packed[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[: bw * bh]
            if index.max() >= n:
                raise Rejected("BadPalette")
            palettes[k] = np.zeros((BLOCK, BLOCK), np.int64)
            palettes[k][:bh, :bw] = colors[index].reshape(bh, bw)
            continue
        if mode == 3:
            r, dx2, dy2 = data.byte(), data.svarint(), data.svarint()
            if r >= refs or abs(dx2) > MAX_MOTION or abs(dy2) > MAX_MOTION:
                raise Rejected("BadMode")
            moves.append((k, r, dx2, dy2))
        read_sparse(data, MAX_COEFFICIENT, coefficients[k])
    control.end()
    data.end()
    deq = np.array(coefficients, np.int64).reshape(-1, 64) * q
    if np.abs(deq).max() > MAX_DEQUANTISED:
        raise Rejected("BadCoefficient")
    return Parsed(np.array(modes), inverse_wht(deq.reshape(-1, BLOCK, BLOCK)).reshape(-1, 64), moves, palettes)


def _fill(recon: np.ndarray, lay: wavefront.Layout, plane: int, parsed: Parsed, refs: list[np.ndarray]) -> None:
    """The blocks of a plane that are palettes or come from other frames: all of a reference at once."""
    first = lay.first[plane]
    for k, samples in parsed.palettes.items():
        recon[lay.own[first + k]] = samples.ravel()
    for r in range(len(refs)):
        mine = [m for m in parsed.moves if m[1] == r]
        if mine:
            k, _, dx2, dy2 = (np.array(c) for c in zip(*mine, strict=True))
            got = motion(refs[r], lay.x[first + k], lay.y[first + k], dx2, dy2).reshape(-1, 64)
            recon[lay.own[first + k]] = (got + parsed.residual[k]).clip(0, 255)


def plane_shapes(width: int, height: int) -> list[tuple[int, int]]:
    return [(height, width), *[(height // 2, width // 2)] * 2]


def reconstruct(shapes: list[tuple[int, int]], parsed: list[Parsed], refs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Parsed planes and, for each, those of the references; intra blocks by anti-diagonals, those of all planes together."""
    lay = wavefront.layout(*shapes)
    recon = np.full(lay.samples, 128, np.int64)
    for i, p in enumerate(parsed):
        _fill(recon, lay, i, p, refs[i])
    wavefront.rebuild(lay, recon, np.concatenate([p.modes for p in parsed]), np.concatenate([p.residual for p in parsed]))
    return lay.planes(recon)


def referenced(head: Header, references: dict[int, Frame | Plane]) -> list:
    """The frames (or planes of frames) that a header names, if they are retained and of its size."""
    refs = []
    for d in head.deps:
        if d not in references:
            raise Rejected("ReferenceMissing", d)
        if references[d].size != (head.width, head.height):
            raise Rejected("ReferenceShape")
        refs.append(references[d])
    return refs


def inflated(payloads: list[bytes], planes: int = 3) -> Callable[[bytes], bytes]:
    """What decompresses the entropy blocks of some payloads: all of them at once, each block a lane; a rejection comes when its block is asked for."""
    blocks: dict[bytes, bytes | Rejected | None] = {}
    for b in payloads:
        try:
            blocks |= dict.fromkeys(x for e in _envelopes(b, read_header(b).body, planes) for x in e)
        except Rejected:
            continue
    known = dict(zip(blocks, lanes.decompress_many(list(blocks), MAX_ENTROPY), strict=True))

    def inflate(block: bytes) -> bytes:
        got = known[block] if block in known else decompress(block, MAX_ENTROPY)
        if isinstance(got, Rejected):
            raise got
        return got

    return inflate


def decode(b: bytes, references: dict[int, Frame], inflate: Callable[[bytes], bytes] = lambda block: decompress(block, MAX_ENTROPY)) -> tuple[Header, Frame]:
    """One frame; ``references`` are the retained frames by id."""
    head = read_header(b)
    refs = referenced(head, references)
    shapes = plane_shapes(head.width, head.height)
    parsed = [parse_plane(e, h, w, head.q, len(refs), inflate) for e, (h, w) in zip(_envelopes(b, head.body), shapes, strict=True)]
    return head, Frame(tuple(reconstruct(shapes, parsed, [[r.planes[i] for r in refs] for i in range(3)])))


class Retained:
    """The last four frames of a stream within an epoch, oldest out first."""

    def __init__(self):
        self.frames: dict = {}

    def add(self, frame_id: int, frame: Frame | Plane) -> None:
        if frame_id in self.frames:
            raise Rejected("BadHeader")
        self.frames[frame_id] = frame
        if len(self.frames) > MAX_REFS:
            del self.frames[next(iter(self.frames))]


class Decoder:
    """Decodes the frames of one stream and epoch in order."""

    def __init__(self):
        self.kept = Retained()

    def decode(self, b: bytes, *inflate: Callable[[bytes], bytes]) -> tuple[Header, Frame]:
        head, frame = decode(b, self.kept.frames, *inflate)
        self.kept.add(head.frame_id, frame)
        return head, frame


# --- encoding -------------------------------------------------------------------------------------------------------


def _search(src: np.ndarray, tiles: np.ndarray, inside: np.ndarray, at: np.ndarray, ref: HalfSamples, radius: int, pattern: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sad, dx2, dy2) of every block: whole-sample square around zero, then the half samples around the best.

    With ``pattern`` the square is not searched whole: blocks step to their best neighbour, two samples away
    and then one, as long as that improves.

    All blocks try one displacement at a time: whole samples by one difference of whole planes, summed up by block. A later
    displacement wins only if strictly better: zero comes first, then rows, then columns; blocks that match exactly are not refined.
    """
    h, w = src.shape
    x, y, zero = at[:, 0], at[:, 1], np.zeros(len(at), np.int64)
    ny, nx = -(-h // BLOCK), -(-w // BLOCK)
    space = np.zeros((ny * BLOCK, nx * BLOCK), np.int16)
    d = space[:h, :w]

    def whole(dx: int, dy: int) -> np.ndarray:
        np.subtract(src, ref.shifted(dx, dy, h, w), out=d)
        np.abs(d, out=d)
        rows = space.reshape(ny, BLOCK, -1).sum(axis=1, dtype=np.int16)  # a block's sum is at most 64 * 255: it stays within 16 bits
        return rows.reshape(ny, nx, BLOCK).sum(axis=2, dtype=np.int64).ravel()

    best, bx, by = whole(0, 0), zero.copy(), zero.copy()

    def take(s: np.ndarray, dx2: np.ndarray, dy2: np.ndarray, which: np.ndarray) -> None:
        better = s < best[which]
        n = which[better]
        best[n], bx[n], by[n] = s[better], dx2[n], dy2[n]

    def attempt(dx2: np.ndarray, dy2: np.ndarray, which: np.ndarray) -> None:
        which = np.flatnonzero(which)
        if len(which):
            d = np.abs(tiles[which] - ref.at(x[which], y[which], dx2[which], dy2[which]))
            d *= inside[which]
            take(d.reshape(len(which), -1).sum(axis=1), dx2, dy2, which)

    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    for step in (2, 1) if pattern else ():
        moving = best > 0
        while moving.any():
            before, cx, cy = best.copy(), bx.copy(), by.copy()
            for dx, dy in around:
                x2, y2 = cx + 2 * step * dx, cy + 2 * step * dy
                attempt(x2, y2, moving & (np.abs(x2) <= 2 * radius) & (np.abs(y2) <= 2 * radius))
            moving = (best < before) & (best > 0)
    every = np.arange(len(at))
    for dy in () if pattern else range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx or dy:
                take(whole(dx, dy), zero + 2 * dx, zero + 2 * dy, every)
    cx, cy = bx.copy(), by.copy()
    for dx, dy in around:
        attempt(cx + dx, cy + dy, best > 0)
    return best, bx, by


def palette(block: np.ndarray) -> tuple[list[int], np.ndarray] | None:
    """Colours in order of first appearance and the index of each sample, for 16 or more samples of up to 4 colours."""
    flat = block.ravel()
    if len(flat) < 16:
        return None
    values, first, back = np.unique(flat, return_index=True, return_inverse=True)
    if len(values) > 4:
        return None
    rank = np.argsort(np.argsort(first))
    return values[np.argsort(first)].tolist(), rank[back]


def _tiles(lay: wavefront.Layout, frame: Frame) -> np.ndarray:
    return lay.flat([p.astype(np.int64) for p in frame.planes])[lay.own]


def _from_references(lay: wavefront.Layout, frame: Frame, tiles: np.ndarray, references: list[Frame], q: int, preset: str) -> wavefront.Inter:
    """The best block of all references for every block, searched and coded for all at once."""
    parts = []
    for i, src in enumerate(frame.planes):
        own = slice(lay.first[i], lay.first[i + 1])
        at, inside, mine = np.stack([lay.x[own], lay.y[own]], axis=1), lay.inside[own].reshape(-1, BLOCK, BLOCK), tiles[own].reshape(-1, BLOCK, BLOCK)
        halves = [HalfSamples(r.planes[i]) for r in references]
        found = [_search(src.astype(np.int16), mine, inside, at, r, PRESETS[preset][0], preset == "fast") for r in halves]
        which = np.argmin(np.stack([f[0] for f in found]), axis=0)  # the first of equals
        sad, dx2, dy2 = (np.choose(which, [f[j] for f in found]) for j in range(3))
        pred = np.zeros((len(at), BLOCK, BLOCK), np.int64)
        for r, ref in enumerate(halves):
            k = np.flatnonzero(which == r)
            pred[k] = ref.at(at[k, 0], at[k, 1], dx2[k], dy2[k])
        parts.append((sad, which, dx2, dy2, pred.reshape(-1, 64)))
    sad, which, dx2, dy2, pred = (np.concatenate(x) for x in zip(*parts, strict=True))
    err, rate, coded, got = wavefront.residuals((tiles - pred) * lay.inside, pred, tiles, lay.inside, q)
    rate = rate + 1 + wavefront.signed_lens(dx2) + wavefront.signed_lens(dy2)
    return wavefront.Inter(sad, which, dx2, dy2, err, rate, coded, got)


def _palettes(lay: wavefront.Layout, tiles: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[int], np.ndarray]]]:
    """How many colours each block's palette has (0 for none), and the palettes."""
    ordered = np.sort(tiles, axis=1)
    few = ((ordered[:, 1:] != ordered[:, :-1]).sum(axis=1) <= 4) | ~lay.inside.all(axis=1)  # the rest have more than four colours
    count, out = np.zeros(lay.count, np.int64), {}
    for k in np.flatnonzero(few).tolist():
        if found := palette(tiles[k][lay.inside[k]]):
            count[k], out[k] = len(found[0]), found
    return count, out


def _serialise(lay: wavefront.Layout, plane: int, chosen: wavefront.Chosen, inter: wavefront.Inter | None, place: dict[int, int], palettes: dict) -> tuple[bytes, tuple[bytes, bytes]]:
    """A plane's blocks mixed, and apart: mode bytes, everything else."""
    own = slice(lay.first[plane], lay.first[plane + 1])
    mode, coded = chosen.mode[own], np.where(chosen.mode[own, None] < 4, chosen.coded[own], 0)
    n = len(mode)
    zigzag = lambda v: (v << 1) ^ (v >> 63)
    items = [(np.arange(n), np.full(n, -1), mode, True)]
    moved = np.flatnonzero(mode == 3)
    if len(moved):
        ref, dx2, dy2 = (x[own][moved] for x in (inter.ref, inter.dx2, inter.dy2))
        items += [(moved, np.full(len(moved), 0), np.array([place[r] for r in ref.tolist()]), True), (moved, np.full(len(moved), 1), zigzag(dx2), False), (moved, np.full(len(moved), 2), zigzag(dy2), False)]
    plain = np.flatnonzero(mode < 4)
    block, index = np.nonzero(coded)
    items += [(plain, np.full(len(plain), 3), np.count_nonzero(coded[plain], axis=1), False), (block, 4 + 2 * index, index, False), (block, 5 + 2 * index, zigzag(coded[block, index]), False)]
    for k in np.flatnonzero(mode == 4).tolist():
        colors, at = palettes[own.start + k]
        packed = (np.pad(at, (0, -len(at) % 4)).reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1)
        whole = np.array([len(colors), *colors, len(at), *packed.tolist()])
        items.append((np.full(len(whole), k), np.arange(len(whole)), whole, True))
    block, order, value = (np.concatenate([x[j] for x in items]) for j in range(3))
    raw = np.repeat([x[3] for x in items], [len(x[0]) for x in items])
    mixed, at = wavefront.varints(block, order, value, raw, n)
    keep = np.ones(len(mixed), bool)
    keep[at[:-1]] = False  # a block begins with its mode
    both = np.frombuffer(mixed, np.uint8)
    return mixed, (both[~keep].tobytes(), both[keep].tobytes())


@dataclass
class Coded:
    """A frame before its entropy coding, which no other frame waits for."""

    head: bytes
    streams: list[bytes]
    recon: Frame
    deps: list[int]


def prepare(frame_id: int, frame: Frame, references: list[tuple[int, Frame]], q: int = 96, preset: str = "balanced", use_palette: bool = True) -> Coded:
    """Everything of a frame but its entropy coding; ``streams`` has each plane's bytes mixed, its modes, and the rest."""
    width, height = frame.size
    check_size(width, height)
    if not 1 <= q <= 65535:
        raise Rejected("BadQuantizer")
    references = [r for r in references if r[1].size == frame.size][: PRESETS[preset][1]]
    lay = wavefront.layout(*plane_shapes(width, height))
    tiles = _tiles(lay, frame)
    inter = _from_references(lay, frame, tiles, [r for _, r in references], q, preset) if references else None
    count, palettes = _palettes(lay, tiles) if use_palette else (np.zeros(lay.count, np.int64), {})
    chosen = wavefront.decide(lay, tiles, inter, count, q, preset, len(references))
    needed = np.unique(inter.ref[chosen.mode == 3]).tolist() if references else []
    place = {k: n for n, k in enumerate(needed)}
    deps = [references[k][0] for k in needed]
    head = _HEAD.pack(MAGIC, frame_id, width, height, q, len(deps), 1) + struct.pack(f"<{len(deps)}Q", *deps)
    streams = [x for i in range(3) for mixed, split in [_serialise(lay, i, chosen, inter, place, palettes)] for x in (mixed, *split)]
    return Coded(head, streams, Frame(tuple(lay.planes(chosen.recon))), deps)


def finish(coded: Coded, blocks: list[bytes]) -> bytes:
    """The payload of a frame whose streams are compressed. The smaller of the two layouts is taken."""
    out = bytearray(coded.head)
    for i in range(0, 9, 3):
        one, *two = blocks[i : i + 3]
        layout, parts = (0, [one]) if 4 + len(one) <= 8 + sum(map(len, two)) else (1, two)
        out.append(layout)
        for p in parts:
            out += struct.pack("<I", len(p)) + p
    return bytes(out)


def encode(frame_id: int, frame: Frame, references: list[tuple[int, Frame]], q: int = 96, preset: str = "balanced", use_palette: bool = True) -> tuple[bytes, Frame, list[int]]:
    """(payload, reconstruction, ids of the references that some block uses)."""
    coded = prepare(frame_id, frame, references, q, preset, use_palette)
    return finish(coded, [compress(s) for s in coded.streams]), coded.recon, coded.deps


@dataclass
class Plane:
    """One plane of a frame, with the frame's size."""

    size: tuple[int, int]
    samples: np.ndarray


#: In which order a frame's rejections count; a plane's own is PLANE and its number.
HEADER, REFERENCE, ENVELOPE, PLANE, REPEATED, STREAM = 0, 1, 2, 3, 6, 7


class PlaneDecoder:
    """Decodes one plane of the frames of a stream and epoch in order: a plane refers to the same plane of other frames alone."""

    def __init__(self, plane: int):
        self.plane, self.kept = plane, Retained()

    @staticmethod
    def _step(order: int, f: Callable, *args):
        """f(*args); a rejection's detail is the order in which it counts."""
        try:
            return f(*args)
        except Rejected as e:
            raise Rejected(e.code, order) from e

    def references(self, head: Header) -> list[Plane]:
        return self._step(REFERENCE, referenced, head, self.kept.frames)

    def decode(self, head: Header, blocks: list[bytes], size: tuple[int, int], inflate: Callable[[bytes], bytes]) -> np.ndarray:
        """The plane of a frame; ``size`` is that of the stream."""
        refs = self.references(head)
        shape = plane_shapes(head.width, head.height)[self.plane]
        parsed = self._step(PLANE + self.plane, parse_plane, blocks, *shape, head.q, len(refs), inflate)
        (samples,) = reconstruct([shape], [parsed], [[r.samples for r in refs]])
        self._step(REPEATED, self.kept.add, head.frame_id, Plane((head.width, head.height), samples))
        if (head.width, head.height) != size:
            raise Rejected("BadStream", STREAM)
        return samples


class Encoder:
    """Encodes the frames of one stream and epoch in order; newest references first."""

    def __init__(self, q: int = 96, preset: str = "balanced", use_palette: bool = True):
        self.options, self.kept = (q, preset, use_palette), Retained()

    def encode(self, frame_id: int, frame: Frame) -> tuple[bytes, Frame, list[int]]:
        out = encode(frame_id, frame, list(reversed(self.kept.frames.items())), *self.options)
        self.kept.add(frame_id, out[1])
        return out

    def encode_all(self, frames: Iterator[tuple[int, Frame]]) -> Iterator[bytes | Rejected]:
        """Payloads of frames in order, TOGETHER of them entropy-coded at once."""
        held: list[Coded | Rejected] = []

        def out() -> Iterator[bytes | Rejected]:
            good = [c for c in held if isinstance(c, Coded)]
            blocks = iter(lanes.compress_many([s for c in good for s in c.streams]))
            for c in held:
                yield finish(c, [next(blocks) for _ in c.streams]) if isinstance(c, Coded) else c
            held.clear()

        for frame_id, frame in frames:
            try:
                if isinstance(frame, Rejected):
                    raise frame
                held.append(prepare(frame_id, frame, list(reversed(self.kept.frames.items())), *self.options))
                self.kept.add(frame_id, held[-1].recon)
            except Rejected as e:
                held.append(e)
            if len(held) == TOGETHER:
                yield from out()
        yield from out()


def psnr_db(a: Frame, b: Frame) -> float:
    """Over all samples of the three planes; infinite if they agree."""
    if a.size != b.size:
        raise Rejected("BadDimensions")
    d = [(p.astype(np.int64) - q.astype(np.int64)) ** 2 for p, q in zip(a.planes, b.planes, strict=True)]
    err, n = sum(int(x.sum()) for x in d), sum(x.size for x in d)
    return math.inf if err == 0 else 10 * math.log10(255 * 255 * n / err)


def scene_cut(a: Frame, b: Frame) -> bool:
    """Mean absolute luma difference over at most about 4096 evenly spaced samples is above 48."""
    x, y = a.planes[0].ravel(), b.planes[0].ravel()
    if len(x) != len(y):
        return True
    step = max(len(x) // 4096, 1)
    d = np.abs(x[::step].astype(np.int64) - y[::step].astype(np.int64))
    return int(d.sum()) // len(d) > 48
