"""The codecs and the container against properties, hostile input and a plain second reading of the format."""

import random
import struct

import numpy as np
import pytest

from tessera.functions.checksum import CHECK, crc32c
from tessera.operators import audio, entropy, video, wire, y4m
from tessera.operators.errors import Rejected
from tessera.streaming.packets import Parser


def code(f, *a):
    try:
        f(*a)
    except Rejected as e:
        return e.code
    return None


def frame(w, h, f, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return video.Frame(tuple(np.ascontiguousarray(p) for p in (f(x, y, rng), f(x, y, rng)[: h // 2, : w // 2], f(x, y, rng)[: h // 2, : w // 2])))


CONTENT = {
    "flat": lambda x, y, r: np.full(x.shape, 77, np.uint8),
    "gradient": lambda x, y, r: (x * 3 + y * 5).astype(np.uint8),
    "checker": lambda x, y, r: ((x // 4 + y // 4) % 2 * 200).astype(np.uint8),
    "noise": lambda x, y, r: r.integers(0, 256, x.shape).astype(np.uint8),
    "impulse": lambda x, y, r: ((x == 5) & (y == 5)).astype(np.uint8) * 255,
}


def test_checksum_vector():
    assert crc32c(b"123456789") == CHECK and crc32c(b"") == 0


@pytest.mark.parametrize("v", [0, 1, 127, 128, 2**32 - 1, 2**64 - 1])
def test_varint(v):
    out = bytearray()
    entropy.put_uvarint(v, out)
    c = entropy.Cursor(bytes(out))
    assert c.uvarint() == v and c.at == len(out)


@pytest.mark.parametrize("v", [-(2**31), -100_000, -1, 0, 1, 127, 128, 100_000, 2**31 - 1])
def test_signed_varint(v):
    out = bytearray()
    entropy.put_svarint(v, out)
    assert entropy.Cursor(bytes(out)).svarint() == v


@pytest.mark.parametrize("raw,want", [(b"\x80\x00", "OverlongVarint"), (b"\x81\x00", "OverlongVarint"), (b"\xff" * 11, "VarintOverflow"), (b"\x82\x80\x00", "OverlongVarint"), (b"\x80", "UnexpectedEof")])
def test_bad_varints(raw, want):
    assert code(entropy.Cursor(raw).uvarint) == want


@pytest.mark.parametrize("data", [b"", b"\7" * 10_000, bytes(((i * i + 17 * i) >> 3) & 255 for i in range(20_000)), bytes(range(256)) * 3, b"ab"])
def test_entropy(data):
    block = entropy.compress(data)
    assert entropy.decompress(block, 1 << 20) == data and len(block) <= len(data) + 5
    assert sum(entropy.normalised(data)) == 4096
    for k in range(len(block) if len(block) < 300 else 40):
        assert code(entropy.decompress, block[:k], 1 << 20) is not None
    assert code(entropy.decompress, b"\1" + block[1:], 1 << 20) == "BadEntropyHeader"
    assert code(entropy.decompress, block + b"\0", 1 << 20) == "TrailingData"


@pytest.mark.parametrize("channels", range(1, 9))
@pytest.mark.parametrize("frames", [1, 63, 64, 65, 257, 1023, 4096])
def test_audio(channels, frames):
    rng = np.random.default_rng(channels * frames)
    pcm = rng.integers(-32768, 32768, frames * channels).astype(np.int16)
    rate, ch, back = audio.decode(audio.encode(pcm, 48_000, channels, 1, channels == 2))
    assert (rate, ch) == (48_000, channels) and (back == pcm).all()
    quiet = (pcm // 4).astype(np.int16)
    for q in (3, 31, 256):
        assert len(audio.decode(audio.encode(quiet, 8_000, channels, q))[2]) == len(pcm)


def test_audio_rejections():
    pcm = np.arange(200, dtype=np.int16)
    good = audio.encode(pcm, 48_000, 2, 1, True)
    for k in range(len(good)):
        assert code(audio.decode, good[:k]) is not None
    patch = lambda at, v: good[:at] + bytes([v]) + good[at + 1 :]
    assert code(audio.decode, patch(0, 0)) == "BadHeader" and code(audio.decode, patch(4, 9)) == "BadChannels"
    assert code(audio.decode, patch(5, 2)) == "BadHeader" and code(audio.decode, good + b"x") == "TrailingData"
    assert code(audio.encode, np.zeros(4097, np.int16), 48_000, 1) == "BadFrames" and code(audio.encode, pcm, 7_999, 1) == "BadRate"
    assert code(audio.encode, np.full(64, 32767, np.int16), 48_000, 1, 65_535) in (None, "SampleOverflow")
    assert audio.snr_db(pcm, pcm) == float("inf") and code(audio.snr_db, pcm, pcm[:9]) == "BadFrames"


def test_haar_by_definition():
    rng = random.Random(1)
    for _ in range(50):
        v = [rng.randint(-40_000, 40_000) for _ in range(64)]
        w, n = list(v), 64
        while n > 1:
            d = [w[i + 1] - w[i] for i in range(0, n, 2)]
            w[:n] = [w[2 * k] + (d[k] >> 1) for k in range(n // 2)] + d
            n //= 2
        x = np.array([v])
        assert audio.haar(x)[0].tolist() == w and audio.inverse_haar(audio.haar(x))[0].tolist() == v


def plain_decode(b, refs):
    """A second reading of the frame syntax, sample by sample."""
    head = video.read_header(b)
    out = []
    for plane, blocks in enumerate(video._envelopes(b, head.body)):
        w, h = (head.width, head.height) if plane == 0 else (head.width // 2, head.height // 2)
        data = entropy.Cursor(entropy.decompress(blocks[-1], 1 << 23))
        ctl = entropy.Cursor(entropy.decompress(blocks[0], 1 << 23)) if len(blocks) == 2 else data
        rec = [[0] * w for _ in range(h)]
        for by in range(0, h, 8):
            for bx in range(0, w, 8):
                cells = [(x, y) for y in range(by, min(by + 8, h)) for x in range(bx, min(bx + 8, w))]
                mode = ctl.byte()
                if mode == 4:
                    colors = data.take(data.byte())
                    n = data.byte()
                    packed = data.take(-(-n // 4))
                    for k, (x, y) in enumerate(cells):
                        rec[y][x] = colors[packed[k // 4] >> 2 * (k % 4) & 3]
                    continue
                if mode == 3:
                    ref, dx, dy = refs[head.deps[data.byte()]].planes[plane].tolist(), data.svarint(), data.svarint()
                q = [0] * 64
                for _ in range(data.uvarint()):
                    i = data.uvarint()
                    q[i] = data.svarint() * head.q
                t = [sum(q[i] * (-1) ** bin(i & k).count("1") for i in range(64)) for k in range(64)]
                pred = {}
                for x, y in cells:
                    if mode == 3:
                        x2, y2 = 2 * x + dx, 2 * y + dy
                        at = lambda a, c: ref[min(max(c, 0), h - 1)][min(max(a, 0), w - 1)]  # noqa: B023, E731
                        x0, y0, fx, fy = x2 // 2, y2 // 2, x2 % 2, y2 % 2
                        pred[x, y] = (at(x0, y0) * (2 - fx) * (2 - fy) + at(x0 + 1, y0) * fx * (2 - fy) + at(x0, y0 + 1) * (2 - fx) * fy + at(x0 + 1, y0 + 1) * fx * fy + 2) // 4
                    elif mode == 1:
                        pred[x, y] = rec[y][bx - 1] if bx else 128
                    elif mode == 2:
                        pred[x, y] = rec[by - 1][x] if by else 128
                    else:
                        near = ([rec[by - 1][a] for a in range(bx, min(bx + 8, w))] if by else []) + ([rec[c][bx - 1] for c in range(by, min(by + 8, h))] if bx else [])
                        pred[x, y] = (sum(near) + len(near) // 2) // len(near) if near else 128
                for x, y in cells:
                    v = t[(y - by) * 8 + x - bx]
                    r = (v + 32) // 64 if v >= 0 else -((-v + 32) // 64)
                    rec[y][x] = min(max(pred[x, y] + r, 0), 255)
        out.append(rec)
    return out


@pytest.mark.parametrize("preset", video.PRESETS)
@pytest.mark.parametrize("q", [1, 17, 193])
@pytest.mark.parametrize("size", [(2, 2), (18, 10), (34, 26)])
def test_video_chain(preset, q, size):
    enc, dec, kept = video.Encoder(q, preset), video.Decoder(), {}
    kinds = list(CONTENT.values())
    for i in range(6):
        f = frame(*size, kinds[i % len(kinds)], i // 2)
        payload, rec, deps = enc.encode(i, f)
        head, got = dec.decode(payload)
        assert head.deps == deps and all((a == b).all() for a, b in zip(got.planes, rec.planes))
        assert plain_decode(payload, kept) == [p.tolist() for p in got.planes]
        kept[i] = got
        if q == 1:
            assert all((a == b).all() for a, b in zip(got.planes, f.planes)) and video.psnr_db(got, f) == float("inf")


def test_video_shapes_and_rejections():
    for w, h in ((2, 1024), (1024, 2), (66, 34)):
        f = frame(w, h, CONTENT["gradient"])
        assert all((a == b).all() for a, b in zip(video.decode(video.encode(0, f, [], 1, "fast")[0], {})[1].planes, f.planes))
    f, g = frame(18, 10, CONTENT["noise"]), frame(18, 10, CONTENT["noise"])
    one, rec, _ = video.encode(5, f, [], 17)
    two, _, deps = video.encode(6, g, [(5, rec)], 17)
    assert deps == [5]
    for k in range(len(one)):
        assert code(video.decode, one[:k], {}) is not None
    assert code(video.decode, two, {}) == "ReferenceMissing" and code(video.decode, two, {5: frame(2, 2, CONTENT["flat"])}) == "ReferenceShape"
    patch = lambda b, at, v: b[:at] + bytes([v]) + b[at + 1 :]
    assert code(video.decode, patch(one, 19, 0), {}) == "BadHeader" and code(video.decode, patch(one, 18, 5), {}) == "BadHeader"
    assert code(video.decode, patch(patch(one, 16, 0), 17, 0), {}) == "BadQuantizer" and code(video.decode, patch(one, 12, 17), {}) == "BadDimensions"
    assert code(video.decode, two[:20] + struct.pack("<Q", 6) + two[28:], {6: rec}) == "BadHeader"
    assert code(video.check_size, 8194, 2) == code(video.check_size, 3, 2) == code(video.check_size, 0, 2) == "BadDimensions"
    assert video.palette(np.array([[9, 8], [9, 7]] * 8))[0] == [9, 8, 7] and video.palette(np.arange(16)) is None
    kept = video.Retained()
    for i in range(6):
        kept.add(i, f)
    assert list(kept.frames) == [2, 3, 4, 5]
    assert video.scene_cut(frame(16, 16, CONTENT["flat"]), frame(16, 16, lambda x, y, r: np.full(x.shape, 200, np.uint8)))


def small_file():
    audio_stream = wire.Stream(2, 2, 1, wire.TIMESCALE, 48_000, 1)
    epochs = []
    for e in range(3):
        body = wire.encode_packet(wire.epoch_start(e, e * 1000, 1000))
        for k in range(4):
            body += wire.encode_packet(wire.Packet(3, 2, e * 1000 + k, 20, audio.encode(np.arange(k, k + 90, dtype=np.int16), 48_000, 1)))
        epochs.append((e, e * 1000, 1000, body))
    return wire.build_file([audio_stream], epochs)


def test_container_errors():
    data = small_file()
    p = wire.parse_prefix(data)
    assert [e.id for e in p.epochs] == [0, 1, 2] and p.epochs[0].offset == p.length and sum(e.length for e in p.epochs) == len(data) - p.length
    assert len(list(wire.scan(data, p.length))) == 15
    for k in range(p.length):
        assert code(wire.parse_prefix, data[:k]) == "UnexpectedEof"
    assert code(wire.parse_prefix, b"x" + data[1:]) == "BadMagic"
    head = lambda *a: wire._sealed(struct.pack("<8sHHIIHHI", wire.FILE_MAGIC, *a))
    assert code(wire.decode_header, head(2, 0, 1, 32, 1, 0, 9)) == "UnsupportedVersion"
    assert {code(wire.decode_header, head(*a)) for a in ((1, 1, 1, 32, 1, 0, 9), (1, 0, 2, 32, 1, 0, 9), (1, 0, 1, 33, 1, 0, 9), (1, 0, 1, 32, 1, 1, 9))} == {"BadHeader"}
    assert code(wire.decode_header, head(1, 0, 1, 32, 1, 0, 9)[:-1] + b"\0") == "HeaderChecksum"
    s = wire.Stream(1, 1, 1, 1, 2, 2)
    front = lambda *x: wire.encode_front(list(x), [])
    assert code(wire.decode_front, front(s), 2) == "BadFront" and code(wire.decode_front, front(s) + b"x", 1) == "TrailingData"
    assert code(wire.decode_front, front(s)[:-1] + b"\xff", 1) == "FrontChecksum"
    bad = [wire.Stream(1, 1, 1, 1, 2, 2, 0, 1 << 16), wire.Stream(1, 2, 1, 1, 2, 2, 1), wire.Stream(1, 3, 1, 1, 2, 2), wire.Stream(1, 1, 1, 1, 2, 2, 0, 4)]
    assert {code(wire.decode_front, front(b), 1) for b in bad} == {"BadFront"} and code(wire.decode_front, front(s, s), 2) == "BadFront"
    assert code(wire.decode_front, wire.encode_front([], [wire.Epoch(1, 0, 2**64 - 1, 1, 0)]), 0) == "BadFront"
    packet = wire.encode_packet(wire.Packet(3, 2, 2**64 - 1, 5, b"abc"))
    assert wire.decode_packet(packet).pts == 2**64 - 1
    assert code(wire.decode_packet, packet[:4] + b"\7" + packet[5:]) == "PacketHeaderChecksum" and code(wire.decode_packet, packet[:-1] + b"\0") == "PayloadChecksum"
    assert code(wire.decode_packet, wire._sealed(struct.pack("<4sBBHQII", wire.PACKET_MAGIC, 3, 1, 2, 0, 0, 0)) + bytes(4)) == "BadHeader"
    assert code(wire.decode_packet, wire._sealed(struct.pack("<4sBBHQII", wire.PACKET_MAGIC, 9, 0, 2, 0, 0, 0)) + bytes(4)) == "UnknownPacketKind"
    assert code(wire.decode_packet, packet, 0, 2) == "PacketTooLarge"
    start, body = wire.encode_packet(wire.epoch_start(7, 0, 1)), packet
    assert code(wire.check_epoch, 8, start) == code(wire.check_epoch, 7, body) == code(wire.check_epoch, 7, start + start) == code(wire.check_epoch, 7, b"") == "BadEpoch"
    assert code(wire.route, wire.Packet(2, 2, 0, 0, b""), {2: wire.Stream(2, 2, 1, 1, 1, 1)}) == "BadStream"
    assert wire.unpack_meta(wire.pack_meta(3, 4, 3, True, 2)) == (3, 4, 3, True, 2)


def test_reindex_and_repair():
    data = small_file()
    again, epochs, dropped = wire.regroup(data, False)
    assert again == data and (epochs, dropped) == (3, 0)
    at = [o for o, _ in wire.scan(data, wire.parse_prefix(data).length)]
    broken = bytearray(data)
    broken[at[7] + 40] ^= 255
    assert code(wire.regroup, bytes(broken), False) == "PayloadChecksum"
    fixed, epochs, dropped = wire.regroup(bytes(broken), True)
    assert epochs == 3 and dropped == 1 and len(list(wire.scan(fixed, wire.parse_prefix(fixed).length))) == 14
    orphan = data[: at[0]] + data[at[1] :]
    assert code(wire.regroup, orphan, False) == "BadEpoch" and wire.regroup(orphan, True)[1:] == (2, 4)
    assert code(wire.regroup, data[: at[0]], True) == "BadEpoch"


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_fragments(size):
    data = small_file()
    want = [(o.payload, o.pts) for _, o in wire.scan(data, wire.parse_prefix(data).length)]
    p, got = Parser(0), []
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    order = list(enumerate(parts))
    if size == 64:
        random.Random(1).shuffle(order)
    for i, d in order:
        got += p.push(i, d, i == len(parts) - 1)
    assert [(x.payload, x.pts) for _, _, x, e in got] == want and p.ended and not any(e for *_, e in got)
    assert list(p.push(0, parts[0], False)) == []  # a repeated fragment


def test_stream_failures():
    data = small_file()
    p = Parser(0)
    assert [e for *_, e in p.push(0, data[:-3], True)][-1] == "TrailingData"
    assert [e for *_, e in Parser(0, 50).push(0, data, False)] == ["ResourceLimit"]
    assert [e for *_, e in Parser(0).push(0, b"y" * 40, False)] == ["BadMagic"]
    p = Parser(0, 100)  # parts that come early count, and a rejected file keeps nothing
    assert [e for k in range(9, 0, -1) for *_, e in p.push(k, bytes(30), False)] == ["ResourceLimit"] and p.failed and not p.waiting and not p.held
    assert list(p.push(0, data, False)) == [] and not p.waiting
    for _ in range(60):  # any mutation is classified the same way twice
        rng = random.Random(_)
        b = bytearray(data)
        b[rng.randrange(len(b))] ^= rng.choice((1, 128, 255))
        one, two = ([(s, e) for s, _, _, e in Parser(0).push(0, bytes(b), True)] for _ in range(2))
        assert one == two


def test_y4m():
    clip = y4m.Clip(4, 2, 24, 1, wire.pack_meta(0, 0, 0, True, 1), [frame(4, 2, CONTENT["noise"], i) for i in range(3)])
    back = y4m.parse(y4m.emit(clip))
    assert (back.width, back.height, back.fps_n, back.meta0, len(back.frames)) == (4, 2, 24, clip.meta0, 3)
    assert all((a == b).all() for f, g in zip(clip.frames, back.frames) for a, b in zip(f.planes, g.planes))
    for tag in ("C420p10", "C420p12", "C420p16", "C420paldv", "F65536:1", "F0:1", "W3"):
        assert code(y4m.parse, f"YUV4MPEG2 W4 H2 {tag}\n".encode()) == "BadHeader"
    assert code(y4m.parse, b"YUV4MPEG2 W4 H2\nFRAME\nabc") == "UnexpectedEof"
    assert wire.unpack_meta(y4m.parse(y4m.emit(y4m.Clip(4, 2))).meta0)[4] == 2


def test_experiments():
    from tessera.operators import research as R

    a = np.zeros((32, 32), np.uint8)
    a[4:12, 4:12] = np.arange(64).reshape(8, 8)
    b = np.roll(a, 1, axis=1)
    m = R.motion_merge([a, b])
    assert m["groups"] == 4 and m["accepted_4"] >= m["accepted_0"] and m["lattice_bytes"] >= m["groups"] * 3
    assert (R._grids(b, a, 8, 2)[1][5] == [-1, 0]).all() and R._grids(b, a, 8, 2)[0][5] == 0
    c = R.block_copy(np.tile(np.array([[1, 2], [3, 4]], np.uint8), (8, 8)))
    assert c == {"blocks": 4, "repeated": 3, "palette_repeated": 3, "palette_bytes": 66, "copy_bytes": 6}
    s = R.transform_skip([a, b], 1)
    assert s["sse"] == 0 and s["skip_step"] == 1 and s["blocks"] == 16 and s["bytes"] == R.token_cost(R.wht(R.tiles(b.astype(int) - a)).reshape(-1, 64))
    flat = np.full((16, 16), 9, np.uint8)
    step = flat.copy()
    step[:, 8:] = 13
    d = R.deblock([flat], [step])
    assert d["sse"] == 16 * 8 * 16 and d["sse_2"] == d["sse"] and d["sse_4"] == d["sse"] + 16 * (1 + 9 - 16)
    assert set(R.entropy_lanes(bytes(range(100)))) == {"one_block", "two_lanes"}
