"""State by stream, timers, and the streaming source and sink of containers."""

import os
import shutil

import pandas as pd
import pytest

from tessera.operators import media, video, wire
from tessera.plans import media as plans
from tessera.sources import container
from tessera.streaming import packets as P
from tessera.streaming.encode import FRAMES_IN, encode_epochs
from tests.conftest import SF
from tests.test_wavefront import clip


class Value:
    def __init__(self):
        self.v, self.written = None, 0

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v
        self.written += sum(len(x) for x in v if isinstance(x, bytes))

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.m, self.written = {}, 0

    def containsKey(self, k):
        return k in self.m

    def getValue(self, k):
        return self.m.get(k)

    def updateValue(self, k, v):
        self.m[k] = v
        self.written += sum(len(x) for x in v if isinstance(x, bytes))

    def removeKey(self, k):
        self.m.pop(k, None)

    def keys(self):
        return iter(list(self.m))

    def clear(self):
        self.m.clear()


class Handle:
    """What a processor keeps, with the bytes that it writes."""

    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, []

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def batch(processor, rows, at=0, key=("f",)):
    df = pd.DataFrame(rows, columns=["generation", "part", "data", "last"])
    return pd.concat(list(processor.handleInputRows(key, iter([df]), Now(at))))


def two_streams(frames=4, w=64, h=48):
    """A file of two video streams and one of sound: each stream's packets, apart."""
    from tessera.operators import audio
    import numpy as np

    streams = [wire.Stream(1, 1, 1, wire.TIMESCALE, w, h), wire.Stream(2, 1, 1, wire.TIMESCALE, w, h), wire.Stream(3, 2, 1, wire.TIMESCALE, 48_000, 1)]
    enc = {s: list(video.Encoder(48, "quality").encode_all(enumerate(clip("pan", w, h, frames, s)))) for s in (1, 2)}
    packets = [wire.epoch_start(0, 0, 1000)]
    packets += [wire.Packet(2, s, i, 1, enc[s][i]) for s in (1, 2) for i in range(frames)]
    packets += [wire.Packet(3, 3, i, 1, audio.encode(np.arange(200, dtype=np.int16) + i, 48_000, 1)) for i in range(20)]
    packets += [wire.Packet(2, 1, frames, 1, video.encode(frames, next(clip("ui", w, h, 1)), [], 48, "fast")[0])]
    data = list(map(wire.encode_packet, packets))
    return wire.index_of(streams, [(0, 0, 1000, sum(map(len, data)))]), data, frames


def test_an_idle_stream_writes_nothing():
    head, data, n = two_streams()
    p, handle = P.MediaProcessor(), Handle()
    p.init(handle)
    out = [batch(p, [(0, 0, head + b"".join(data[: 1 + 2 * n]), False)])]
    frames, area = handle.maps["frames"], 64 * 48 * 3 // 2
    assert len(frames.m) == 8 and frames.written == 8 * area
    written = []
    for k in range(20):  # sound alone
        before = frames.written, handle.values["parser"].written
        out.append(batch(p, [(0, 1 + k, data[1 + 2 * n + k], False)]))
        assert frames.written == before[0]
        written.append(handle.values["parser"].written - before[1])
    assert max(written) == min(written) < 3000
    held = set(frames.m)
    out.append(batch(p, [(0, 21, data[-1], True)]))  # one frame of one stream: that frame alone
    assert frames.written == 9 * area and {k for k in held if k[0] == 2} <= set(frames.m) and len(frames.m) == 8
    got = pd.concat(out)
    assert got.error_code.isna().all() and (got.kind == "video_frame").sum() == 2 * n + 1 and (got.kind == "audio_frame").sum() == 20


def test_state_over_batches_decodes_the_same():
    head, data, n = two_streams()
    rows = []
    for size in (10**9, 900):
        p, handle = P.MediaProcessor(), Handle()
        p.init(handle)
        whole = head + b"".join(data)
        parts = [whole[i : i + size] for i in range(0, len(whole), size)]
        got = pd.concat([batch(p, [(0, k, x, k == len(parts) - 1)]) for k, x in enumerate(parts)])
        rows.append([(r.kind, r.stream_id, r.y, r.u, r.v, r.samples if isinstance(r.samples, list) else None) for r in got.itertuples()])
    assert repr(rows[0]) == repr(rows[1])


def test_a_new_generation_and_an_epoch_start_clear_what_is_retained():
    head, data, n = two_streams()
    p, handle = P.MediaProcessor(), Handle()
    p.init(handle)
    batch(p, [(0, 0, head + b"".join(data[: 1 + n]), False)])
    assert len(handle.maps["frames"].m) == 4
    again = batch(p, [(1, 0, head + b"".join(data[:3]), False)])
    assert len(handle.maps["frames"].m) == 2 and again.error_code.isna().all()
    batch(p, [(1, 1, wire.encode_packet(wire.epoch_start(1, 9, 9)), False)])
    assert not handle.maps["frames"].m


def test_timers_drop_what_is_abandoned():
    head, data, n = two_streams()
    p, handle = P.MediaProcessor(idle_ms=5000), Handle()
    p.init(handle)
    batch(p, [(0, 0, head + b"".join(data[: 1 + n]), False), (0, 7, b"early", False)], at=1000)
    batch(p, [(0, 1, data[1 + n], False)], at=2500)
    assert handle.timers == [7500] and handle.maps["waiting"].m and handle.maps["frames"].m
    (told,) = p.handleExpiredTimer(("f",), Now(8000), None)
    assert told.error_code.tolist() == ["Abandoned"] and not handle.values["parser"].exists() and not handle.maps["waiting"].m and not handle.maps["frames"].m
    ended = batch(p, [(0, 0, head + b"".join(data), True)], at=9000)
    assert ended.error_code.isna().all()
    (told,) = p.handleExpiredTimer(("f",), Now(99_000), None)
    assert len(told) == 0


@pytest.fixture(scope="module")
def frames(spark):
    c = plans.clips(spark, SF).select("clip_id", "frame_index", "width", "height", "y", "u", "v", (plans.F.col("frame_index") == 11).alias("last"))
    return spark.createDataFrame(c.where("clip_id IN ('pan', 'noise', 'cut')").collect(), c.schema)


def encode_to(spark, source, out, checkpoint):
    with plans.setting(spark, "spark.sql.streaming.stateStore.providerClass", P.PROVIDER):
        stream = spark.readStream.schema(FRAMES_IN + ", last boolean").option("maxFilesPerTrigger", 1).parquet(source)
        container.sink(encode_epochs(stream, 1, plans.FRAME_US, 48, "fast", 3, True), out, checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_a_restarted_query_gives_the_same_files(spark, frames, tmp_path):
    """Stopped between batches, and again after a commit that the query does not know of: the files are those of one run."""
    for k in range(4):
        frames.where(f"frame_index % 4 = {k}" if k < 2 else f"frame_index % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    names = sorted((n for n in os.listdir(f"{tmp_path}/all") if n.startswith("part")), key=lambda n: os.path.getmtime(f"{tmp_path}/all/{n}"))
    for i, n in enumerate(names):
        os.utime(f"{tmp_path}/all/{n}", (1000 + i, 1000 + i))
    encode_to(spark, f"{tmp_path}/all", f"{tmp_path}/one", f"{tmp_path}/c1")
    os.mkdir(f"{tmp_path}/part")
    for i, n in enumerate(names):
        shutil.copy2(f"{tmp_path}/all/{n}", f"{tmp_path}/part/{n}")
        if i in (1, 3):
            encode_to(spark, f"{tmp_path}/part", f"{tmp_path}/two", f"{tmp_path}/c2")
    read = lambda d: {n: open(f"{tmp_path}/{d}/{n}", "rb").read() for n in sorted(os.listdir(f"{tmp_path}/{d}")) if n.endswith(".bin")}
    assert read("one") and read("one") == read("two")
    commits = sorted((int(n) for n in os.listdir(f"{tmp_path}/c2/commits") if n.isdigit()))
    os.remove(f"{tmp_path}/c2/commits/{commits[-1]}")
    for n in os.listdir(f"{tmp_path}/c2/commits"):
        if n.startswith(f".{commits[-1]}"):
            os.remove(f"{tmp_path}/c2/commits/{n}")
    encode_to(spark, f"{tmp_path}/part", f"{tmp_path}/two", f"{tmp_path}/c2")
    assert read("one") == read("two")
    want = {(r.file_id, r.seq, bytes(r.payload)) for r in media.encode_video(media.epochs_by_cut(frames, 3), 1, plans.FRAME_US, 48, "fast").collect()}
    got = container.load(spark, f"{tmp_path}/two").where("kind = 'video_frame'").collect()
    assert {(r.file_id.split(".")[0], int(r.pts) // plans.FRAME_US, bytes(r.payload)) for r in got} == want


def test_fragments_of_growing_files(tmp_path):
    """Offsets are bytes read; whole pieces while a file grows, the rest when it is as long as its index says."""
    head, data, _ = two_streams()
    whole, name = head + b"".join(data), f"{tmp_path}/a.bin"
    reader = container.FragmentReader({"path": str(tmp_path), "fragment_bytes": "1000"})
    at, got = reader.initialOffset(), []
    for size in (10, 40, 999, 2500, 2500, len(whole) - 1, len(whole), len(whole)):
        with open(name, "wb") as f:
            f.write(whole[:size])
        to = reader.latestOffset()
        assert to == {name: size if size == len(whole) else size // 1000 * 1000}
        got += [r for p in reader.partitions(at, to) for r in reader.read(p)]
        at = to
    assert [r[2] for r in got] == list(range(-(-len(whole) // 1000))) and b"".join(r[3] for r in got) == whole
    assert [r[4] for r in got] == [False] * (len(got) - 1) + [True]
    (tmp_path / "b.bin").write_bytes(b"x" * 1500)
    to = reader.latestOffset()
    assert to[f"{tmp_path}/b.bin"] == 1500 and [r[4] for p in reader.partitions(at, to) for r in reader.read(p)] == [False, True]


def test_small_fragments_share_splits(tmp_path):
    """Splits follow bytes: many small pieces and files to one, a large file cut between pieces; the rows are those of the files, in order."""
    files = {f"{tmp_path}/{k}.bin": bytes([k]) * size for k, size in enumerate((90_000, 110, 130_001, 50_000, 200))}
    for name, data in files.items():
        with open(name, "wb") as f:
            f.write(data)
    for least, most in (("1", 2), ("4", 8)):
        reader = container.FragmentReader({"path": str(tmp_path), "fragment_bytes": "100", "min_splits": least})
        to = reader.latestOffset()
        splits = reader.partitions(reader.initialOffset(), to)
        assert 1 <= len(splits) <= most and len(splits) >= int(least)
        got: dict = {}
        for s in splits:
            for name, _, part, data, last in reader.read(s):
                got.setdefault(f"{tmp_path}/{name}", []).append((part, data, last))
        assert {n: b"".join(d for _, d, _ in sorted(rows)) for n, rows in got.items()} == files
        for name, rows in got.items():
            n = -(-len(files[name]) // 100)
            assert [p for p, *_ in rows] == list(range(n)) and [x for *_, x in rows] == [False] * (n - 1) + [True]
        assert reader.partitions(to, to) == []


def test_parts_in_order_ask_no_state():
    """Parts and frames that come in their turn send no message to the state of those that wait; one that waits costs one to write, read and remove it."""
    from tessera.streaming.packets import Parser, Parts

    class State(dict):
        asked = 0

        def __getattr__(self, name):
            calls = {"containsKey": self.__contains__, "getValue": self.__getitem__, "removeKey": self.__delitem__, "updateValue": self.__setitem__, "keys": lambda: list(dict.keys(self))}

            def call(*args):
                State.asked += 1
                return calls[name](*args)

            return call

    head, data, _ = two_streams()
    whole, state = head + b"".join(data), State()
    pieces = [whole[at : at + 100] for at in range(0, len(whole), 100)]
    parser = Parser(0)
    parser.waiting = Parts(state, set())
    want = [r for k, p in enumerate(pieces) for r in Parser.push(parser, k, p, k == len(pieces) - 1)]
    assert State.asked == 0 and want and parser.ended
    late, order = Parser(0), [1, 2, 0, *range(3, len(pieces))]
    late.waiting = Parts(state, set())
    got = [r for k in order for r in late.push(k, pieces[k], k == len(pieces) - 1)]
    assert State.asked == 6 and [(s, e, c) for s, e, _, c in got] == [(s, e, c) for s, e, _, c in want]
    assert Parts({}, set()).numbers == set() and len(late.waiting) == 0
