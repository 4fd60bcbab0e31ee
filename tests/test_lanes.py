"""Many-lane entropy blocks against the coder of one block."""

import random

import pytest

from tessera.operators import entropy, lanes
from tessera.operators.errors import Rejected


def alone(block, most):
    try:
        return entropy.decompress(block, most)
    except Rejected as e:
        return e.code


def together(blocks, most):
    return [x.code if isinstance(x, Rejected) else x for x in lanes.decompress_many(blocks, most)]


@pytest.fixture(scope="module")
def blocks():
    rnd = random.Random(1)
    out = []
    for _ in range(1500):
        n, a = rnd.choice([0, 1, 2, 5, 30, 200, 1000]), rnd.choice([1, 2, 5, 40, 256])
        out.append(bytes(rnd.choices(range(a), [rnd.random() ** 4 + 1e-9 for _ in range(a)], k=n)) if n else b"")
    return [*out, bytes(rnd.choices(range(60), k=20_000)), bytes(range(256)) * 20, b"a" * 5000, bytes(rnd.choices([0, 1, 2], [5000, 1, 1], k=9000)), bytes([*range(256), *[7] * 90_000])]


def test_lanes_equal_single_blocks(blocks, monkeypatch):
    want = [entropy.compress(b) for b in blocks]
    for size, few, steps in ((1024, 12, 64), (64, 1, 7), (5, 6, 64)):
        for name, value in (("LANES", size), ("FEW", few), ("STEPS", steps)):
            monkeypatch.setattr(lanes, name, value)
        assert lanes.compress_many(blocks) == want and lanes.decompress_many(want, 1 << 20) == blocks
    assert lanes.compress_many([]) == [] == lanes.decompress_many([], 9)


def test_lanes_reject_like_single_blocks(blocks):
    rnd, bad = random.Random(2), []
    for b in [entropy.compress(b) for b in blocks]:
        b, r = bytearray(b), rnd.random()
        if r < 0.5:
            b[rnd.randrange(min(len(b), 40))] ^= 1 << rnd.randrange(8)
        elif r < 0.7:
            b = b[: rnd.randrange(len(b) + 1)]
        elif r < 0.8:
            b += b"x"
        else:
            b[rnd.randrange(len(b))] ^= 1 << rnd.randrange(8)
        bad.append(bytes(b))
    for most in (1 << 20, 100):
        assert together(bad, most) == [alone(b, most) for b in bad]
