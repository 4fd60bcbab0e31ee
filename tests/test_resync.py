"""Repair by byte ranges against the sequential reader, file by file."""

import random

import pytest

from tessera.operators import wire
from tessera.operators.errors import Rejected
from tessera.sources import container
from tessera.sources.resync import Resync, entries, found_in, kept_in

STREAMS = [wire.Stream(1, 1, 1, wire.TIMESCALE, 16, 16), wire.Stream(2, 2, 1, wire.TIMESCALE, 48_000, 1)]


def packets(rnd, epochs, tricky=True):
    out = []
    for e in range(epochs):
        ps = [wire.epoch_start(e, e * 1000, rnd.choice([0, 1000]))]
        for k in range(rnd.randint(0, 6)):
            payload = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 300)))
            if tricky and rnd.random() < 0.4:  # magic, and whole sound packets, inside a payload
                inner = wire.encode_packet(rnd.choice([wire.Packet(3, 2, 1, 1, b"inner"), wire.epoch_start(77, 5, 5), wire.Packet(3, 9, 1, 1, b"x")]))
                payload += rnd.choice([wire.PACKET_MAGIC, inner, inner[:20], inner * 3]) + payload[:50]
            ps.append(wire.Packet(rnd.choice([2, 3, 3, 4]), 0, e * 1000 + k, 1, payload))
        out.append((e, [wire.Packet(p.kind, {2: 1, 3: 2}.get(p.kind, p.stream_id), p.pts, p.duration, p.payload) for p in ps]))
    return out


def cases():
    rnd = random.Random(3)
    good = wire.build_file(STREAMS, [(e, e * 1000, 1000, b"".join(map(wire.encode_packet, ps))) for e, ps in packets(rnd, 12)], checked=False)
    start = wire.parse_prefix(good).length
    out = {"good": good, "empty": good[:start], "bad": b"not a container", "noprefix": good[:-1][:start - 4]}
    for k in range(10):
        b = bytearray(good)
        for _ in range(rnd.randint(1, 6)):
            b[rnd.randrange(start, len(b))] ^= 1 << rnd.randrange(8)
        out[f"flip{k}"] = bytes(b)
        out[f"cut{k}"] = good[: rnd.randrange(start, len(good))]
        i, j = sorted(rnd.randrange(start, len(good)) for _ in range(2))
        out[f"gap{k}"] = good[:i] + good[j:]
        out[f"noise{k}"] = good[:i] + bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 2500))) + good[i:]
    one = b"".join(map(wire.encode_packet, [wire.epoch_start(0, 0, 5), wire.Packet(3, 2, 0, 1, b"a")]))
    head = wire.index_of(STREAMS, [(0, 0, 7, len(one))])
    late = wire.encode_packet(wire.Packet(3, 2, 0, 1, b"early"))
    out |= {"early": head + late + one, "twice": head + one + one, "shortstart": head + wire.encode_packet(wire.Packet(1, 0, 0, 1, b"abc")) + one, "stream": head + one + wire.encode_packet(wire.Packet(3, 5, 0, 1, b"no stream")) + late, "zero": wire.index_of(STREAMS, [(0, 0, 9, len(one))]) + wire.encode_packet(wire.epoch_start(0, 0, 0)) + late}
    return out


def sequential(data, repair):
    try:
        return (*wire.regroup(data, repair), None)
    except Rejected as e:
        return None, None, None, e.code


@pytest.mark.parametrize("span", [64, 500, 1024, 1 << 20])
def test_chain_of_ranges(span):
    """The same packets as one reading, without Spark."""

    class File:
        def __init__(self, b):
            self.b, self.at = b, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.b[self.at : self.at + n]

    from tessera.sources.resync import Held

    for name, data in cases().items():
        try:
            prefix = wire.parse_prefix(data)
        except Rejected:
            continue
        streams = {s.id: s for s in prefix.streams}
        found, turns = {}, {}
        for r in range(prefix.length // span, -(-len(data) // span)):
            lo, hi = max(r * span, prefix.length), min((r + 1) * span, len(data))
            found[r] = found_in(Held(File(data), lo, min(hi + 3, len(data))), lo, hi, len(data), streams)
            turns[r] = [(f[0], f[0], *f[7:]) for f in found[r]]
        kept, dropped = [], 0
        for r, at, hunts in entries(len(data), prefix.length, span, turns):
            for row in kept_in(found.get(r, []), at, hunts, min((r + 1) * span, len(data)), len(data)):
                kept += [row[:2]] * bool(row[1])
                dropped += row[7]
        want, at, lost = [], prefix.length, 0
        while at < len(data):
            try:
                p = wire.decode_packet(data, at)
                wire.route(p, streams)
                if p.kind == 1 and len(p.payload) != 4:
                    lost += 1
                else:
                    want.append((at, p.size))
                at += p.size
            except Rejected:
                lost += 1
                at = data.find(wire.PACKET_MAGIC, at + 1)
                if at < 0:
                    break
        assert (kept, dropped) == (want, lost), (name, span)


def test_resync_equals_sequential(spark, tmp_path):
    files = cases()
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / f"{name}.bin").write_bytes(data)
    r = Resync(spark, str(tmp_path / "in"), str(tmp_path / "work"), span=1024)
    for repair in (True, False):
        want = {f"{n}.bin": sequential(d, repair) for n, d in files.items()}
        got = {x.file_id: (x.epochs, x.dropped, x.error_code) for x in r.outcome(repair).collect()}
        assert got == {n: w[1:] for n, w in want.items()}
        to = str(tmp_path / f"out{repair}")
        r.save(to, repair)
        assert {p.name: p.read_bytes() for p in (tmp_path / f"out{repair}").glob("*.bin")} == {n: w[0] for n, w in want.items() if w[0]}
        assert container.load(spark, to).where("error_code IS NOT NULL").count() == 0


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = Resync(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert r.outcome().count() == 0 and r.epochs().count() == 0
