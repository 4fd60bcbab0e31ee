"""Frames coded by anti-diagonals against frames coded block by block."""

import numpy as np
import pytest

from tessera.operators import video
from tessera.operators.errors import Rejected
from tests import sequential_video as sequential


def clip(kind, w, h, n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (h + 60, w + 120))
    base = (base + np.roll(base, 1, 0) + np.roll(base, 1, 1) + np.roll(base, 2, 0)) // 4
    for t in range(n):
        if kind == "noise":
            p = [rng.integers(0, 256, s) for s in ((h, w), (h // 2, w // 2), (h // 2, w // 2))]
        elif kind == "pan":
            p = [base[t : t + h, 2 * t : 2 * t + w], base[t : t + h // 2, t : t + w // 2], base[t : t + h // 2, 3 : 3 + w // 2]]
        elif kind == "ui":
            y = np.full((h, w), 90)
            y[: h // 2, : w // 3], y[:, t * 3 % w], y[h // 3 : h // 3 + 3] = 220, 30, 7
            p = [y, np.full((h // 2, w // 2), 128), np.where(np.arange(w // 2)[None] % 9 < 4, 100, 140) + np.zeros((h // 2, 1), int)]
        else:
            p = [(np.arange(w)[None] * 2 + np.arange(h)[:, None] * 3 + t) % 256, np.full((h // 2, w // 2), 77 + t), (np.arange(w // 2)[None] + np.zeros((h // 2, 1), int) + t) % 256]
        yield video.Frame.of(w, h, *(x.astype(np.uint8).tobytes() for x in p))


@pytest.mark.parametrize("size", [(48, 32), (18, 10), (2, 2), (36, 50)])
@pytest.mark.parametrize("kind", ["noise", "pan", "ui", "gradient"])
def test_payloads_are_identical(size, kind):
    for preset in video.PRESETS:
        for q in (1, 16, 96, 400):
            frames = list(clip(kind, *size, 5))
            a, b, d = video.Encoder(q, preset), sequential.Encoder(q, preset), video.Decoder()
            want = [b.encode(i, f) for i, f in enumerate(frames)]
            assert [a.encode(i, f)[::2] for i, f in enumerate(frames)] == [w[::2] for w in want]
            payloads = list(video.Encoder(q, preset).encode_all(enumerate(frames)))
            assert payloads == [w[0] for w in want]
            inflate = video.inflated(payloads)
            for payload, w in zip(payloads, want, strict=True):
                for got in (d.decode(payload, inflate)[1],):
                    assert all((x == y).all() for x, y in zip(got.planes, w[1].planes, strict=True))


def outcome(payload, *inflate):
    try:
        return [p.tobytes() for p in video.decode(payload, {}, *inflate)[1].planes]
    except Rejected as e:
        return e.code


def test_rejections_are_the_same_together(monkeypatch):
    """Broken payloads end alike whether their blocks are decoded together or alone, and whether the token fast path is there or not."""
    rng = np.random.default_rng(1)
    good = [next(video.Encoder(q, "balanced").encode_all([(0, next(clip(k, 36, 20, 1)))])) for k in ("noise", "pan", "ui", "gradient") for q in (4, 60)]
    bad = []
    for _ in range(400):
        b = bytearray(good[rng.integers(len(good))])
        for _ in range(rng.integers(1, 3)):
            b[rng.integers(len(b))] ^= 1 << int(rng.integers(8))
        bad.append(bytes(b[: rng.integers(len(b))] if rng.random() < 0.1 else b))
    together = [outcome(b, video.inflated(bad)) for b in bad[:40]] + [outcome(b) for b in bad[40:]]
    monkeypatch.setattr(video, "_plain", lambda *a: None)
    assert together == [outcome(b) for b in bad] and len({x for x in together if isinstance(x, str)}) >= 5


def test_first_use_of_a_reference_is_found_again():
    """Decisions that hang on an earlier block's use of a reference: few bits of gain, so the first guess is wrong somewhere."""
    rng = np.random.default_rng(7)
    for seed in range(6):
        frames = list(clip("pan", 48, 32, 4, seed))
        frames = [video.Frame(tuple(np.clip(p + rng.integers(-6, 7, p.shape), 0, 255).astype(np.uint8) for p in f.planes)) for f in frames]
        for preset in ("balanced", "quality"):
            for q in (8, 40, 200):
                a, b = video.Encoder(q, preset), sequential.Encoder(q, preset)
                assert [a.encode(i, f)[0] for i, f in enumerate(frames)] == [b.encode(i, f)[0] for i, f in enumerate(frames)]
