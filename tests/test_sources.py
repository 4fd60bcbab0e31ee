"""The container data source, Y4M files and the stateful stream on files of their own."""

import os

import pytest

from tessera.operators import media
from tessera.plans import media as plans
from tessera.sources import container, y4m
from tessera.operators import wire
from tessera.operators.video import Frame
from tessera.streaming.packets import FRAGMENTS, OUT, PROVIDER, RANGES, parse_ranges, parse_stream
from tests.conftest import SF
from tests.test_codecs import small_file


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("containers")
    data = small_file()
    (d / "a.bin").write_bytes(data)
    (d / "b.bin").write_bytes(data)
    (d / "bad.bin").write_bytes(b"not a container at all, but long enough to hold a header")
    (d / "short.bin").write_bytes(data[:-20])
    return str(d)


def test_tables(spark, folder):
    files = {r.file_id: r for r in container.load(spark, folder, "files").collect()}
    assert files["a.bin"].stream_count == 1 and files["bad.bin"].error_code == "BadMagic"
    assert container.load(spark, folder, "streams").count() == 3 and container.load(spark, folder, "epochs").count() == 9
    p = container.load(spark, folder)
    rows = p.where("file_id = 'a.bin'").collect()
    assert len(rows) == 15 and sorted(r.seq for r in rows) == [k << 32 | i for k in range(3) for i in range(5)]
    assert {r.error_code for r in p.where("file_id IN ('bad.bin', 'short.bin')").collect()} == {"BadMagic", "BadFront", None}
    meta = container.load(spark, folder, "packets_meta")
    assert "payload" not in meta.columns and meta.where("file_id = 'b.bin' AND kind = 'audio_frame'").count() == 12


def all_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A file of 10,000 epochs, and some small ones."""
    d = tmp_path_factory.mktemp("many")
    epoch = lambda i, n=3: (i, i * 1000, 1000, b"".join(wire.encode_packet(p) for p in [wire.epoch_start(i, i * 1000, 1000), *(wire.Packet(3, 2, i * 1000 + k, 1, bytes([k]) * 40) for k in range(n))]))
    streams = [wire.Stream(2, 2, 1, wire.TIMESCALE, 48_000, 1)]
    (d / "large.bin").write_bytes(wire.build_file(streams, [epoch(i) for i in range(10_000)], checked=False))
    for k in range(30):
        (d / f"small{k}.bin").write_bytes(wire.build_file(streams, [epoch(i) for i in range(2)]))
    (d / "bad.bin").write_bytes(b"nothing that could be read as a container of ours")
    return str(d)


def test_splits_by_bytes(spark, many, monkeypatch):
    """10,000 epochs are a few splits, planned without opening a file, with the rows of one whole read."""
    opened = []
    monkeypatch.setattr(container, "read_prefix", lambda *a: opened.append(a))
    reader = container.ContainerReader({"path": many, "split_bytes": "300000"})
    splits = reader.partitions()
    size = os.path.getsize(f"{many}/large.bin")
    assert not opened and -(-size // 300_000) <= len(splits) <= -(-size // 300_000) + 3
    assert sum(len(s.pieces) for s in splits if s.pieces[0].lo == 0) >= 32
    monkeypatch.undo()
    df = container.load(spark, many, split_bytes="300000")
    assert df.rdd.getNumPartitions() == len(splits)
    whole = container.load(spark, many, min_splits="1")
    assert whole.rdd.getNumPartitions() <= 3 and all_rows(df) == all_rows(whole) and df.count() == 40_000 + 30 * 8 + 1


def test_saved_index(spark, many, folder, tmp_path):
    """Reads that prune plan from the saved index alone; rows are those of the read without it."""
    for where, n in ((many, 10_061), (folder, 10)):
        container.save_index(spark, where, str(tmp_path / f"index{n}"))
        index = spark.read.parquet(str(tmp_path / f"index{n}"))
        assert index.count() == n and index.where("error_code IS NOT NULL").count() == 1
        for o in ({"epochs": "1,7,9999"}, {"from_pts": "1500"}, {"to_pts": "2000"}, {"from_pts": "1000", "to_pts": "3000"}, {"epochs": "0", "from_pts": "1000"}, {}):
            assert all_rows(container.load(spark, where, index=str(tmp_path / f"index{n}"), **o)) == all_rows(container.load(spark, where, **o))
    one = container.load(spark, many, index=str(tmp_path / "index10061"), split_bytes="300000").where("epoch_id = 9000")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4
    half = container.load(spark, many, index=str(tmp_path / "index10061"), split_bytes="300000", min_splits="1").where("pts < 5000000")
    assert 3 <= half.rdd.getNumPartitions() <= 8 and half.count() == 20_000 + 240


def test_seek_reads_only_chosen_epochs(spark, folder):
    one = container.load(spark, f"{folder}/a.bin", epochs="1")
    assert one.rdd.getNumPartitions() == 1 and {r.epoch_id for r in one.collect()} == {1}
    assert container.load(spark, f"{folder}/[ab].bin", min_splits="1").rdd.getNumPartitions() == 1


def test_pushdown(spark, folder):
    """On by default; without it the same rows."""
    for o in ({}, {"pushdown": "false"}):
        one = container.load(spark, f"{folder}/a.bin", **o).where("epoch_id = 2")
        assert {r.epoch_id for r in one.collect()} == {2} and one.count() == 5
    reader = container.PushdownReader({"path": folder})
    kept = list(reader.pushFilters([container.EqualTo(("epoch_id",), 2), container.LessThan(("pts",), 5)]))
    assert reader.epochs == {2} and reader.until == 6 and len(kept) == 2


def test_scan_of_rows_equals_source(spark, folder):
    files = spark.createDataFrame([("a.bin", bytearray(small_file()))], "file_id string, content binary")
    key = lambda r: (r.byte_offset, r.epoch_id, r.kind, r.pts, bytes(r.payload))
    assert sorted(map(key, media.scan(files).collect())) == sorted(map(key, container.load(spark, f"{folder}/a.bin").collect()))


def test_magic_is_an_option(spark, tmp_path):
    other = b"OTHER\0\0\0"
    (tmp_path / "a.bin").write_bytes(other + small_file()[8:])
    assert {r.error_code for r in container.load(spark, str(tmp_path), "files").collect()} == {"BadMagic"}
    data = bytearray(small_file())
    data[:8] = other
    data[28:32] = wire._sealed(bytes(data[:28]))[-4:]
    (tmp_path / "a.bin").write_bytes(bytes(data))
    assert container.load(spark, str(tmp_path), magic="OTHER").where("error_code IS NULL").count() == 15
    assert wire.regroup(bytes(data), False, other)[0] == bytes(data)


def test_sink_writes_epochs(spark, tmp_path):
    """The sink's files are those that are built as values, byte for byte; overwriting replaces what was there."""
    packets, streams = plans.encoded_packets(spark, SF)
    packets = spark.createDataFrame(packets.collect(), packets.schema)
    container.save(media.mux_epochs(packets, streams), str(tmp_path))
    want = {r.file_id: bytes(r.content) for r in media.mux(packets, streams).collect()}
    assert {p.name.removesuffix(".bin"): p.read_bytes() for p in tmp_path.iterdir() if p.name[0] != "."} == want
    container.save(media.mux_epochs(packets.where("file_id = 'pan'"), streams), str(tmp_path), "overwrite", magic="OTHER")
    assert [p.name for p in tmp_path.iterdir() if p.name[0] != "."] == ["pan.bin"]
    assert (tmp_path / "pan.bin").read_bytes()[32:] == want["pan"][32:] and (tmp_path / "pan.bin").read_bytes()[:5] == b"OTHER"
    with pytest.raises(Exception, match="BadX"):
        container.save(media.mux_epochs(packets.withColumn("error_code", plans.F.lit("BadX")), streams), str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").glob("*.bin")]


def test_time_ranges(spark, folder):
    """From the epoch in which a time lies, up to the last that begins before another."""
    ids = lambda **o: {r.epoch_id for r in container.load(spark, f"{folder}/a.bin", **o).collect()}
    assert ids(from_pts="1500") == {1, 2} and ids(from_pts="2000") == {2} and ids(from_pts="0") == {0, 1, 2}
    assert ids(from_pts="1000", to_pts="2000") == {1} and ids(to_pts="1") == {0}
    assert container.load(spark, f"{folder}/a.bin").where("pts < 1002").count() == 5 + 3


def test_play_from_a_time(spark, folder, tmp_path):
    """Decoding from a seek gives the rest of the whole decode."""
    container.save(media.mux_epochs(*plans.encoded_packets(spark, SF)), str(tmp_path))
    key = lambda r: (r.file_id, r.epoch_id, r.pts, bytes(r.y))
    whole = sorted(map(key, container.play(spark, str(tmp_path), 0)[0].collect()))
    some = sorted(map(key, container.play(spark, str(tmp_path), 300_000)[0].collect()))
    first = {}
    for f, e, pts, _ in whole:
        if pts <= 300_000:
            first[f] = max(first.get(f, 0), e)
    assert some == [r for r in whole if r[1] >= first[r[0]]] and 0 < len(some) < len(whole)


def test_clips_of_different_sizes(spark):
    """Each file describes its own frames, so all of them decode."""
    shade = lambda w, h, i: Frame.of(w, h, bytes((x * 3 + i) % 256 for x in range(w * h)), bytes(w * h // 4), bytes(w * h // 4))
    rows = [(f"c{w}", i, w, h, *(p.tobytes() for p in shade(w, h, i).planes)) for w, h in ((24, 16), (48, 32), (18, 10)) for i in range(4)]
    frames = spark.createDataFrame(rows, "clip_id string, frame_index long, width int, height int, y binary, u binary, v binary")
    pcm = spark.createDataFrame([(f"c{w}", k, k * 960, [k] * 960) for w in (24, 48, 18) for k in range(9)], "clip_id string, seq long, first_frame long, samples array<short>")
    files = media.encode_av(frames, pcm, 48_000, 1, (24, 1), 2, 1, "fast")
    assert sorted((r.param0, r.param1) for r in media.streams_of(files).where("kind = 'video'").collect()) == [(18, 10), (24, 16), (48, 32)]
    got = media.decode_media(media.scan(files), media.streams_of(files))[0].collect()
    assert len(got) == 12 and not any(r.error_code for r in got)
    assert {(r.file_id, int(r.frame_id), bytes(r.y)) for r in got} == {(r[0], r[1], r[4]) for r in rows}


def test_audio_only_files(spark):
    pcm = spark.createDataFrame([("x", i, i * 960, [(i * 7 + k) % 100 for k in range(960)]) for i in range(120)], "file_id string, seq long, first_frame long, samples array<short>")
    files = media.encode_audio_only(pcm, 48_000, 1, 1)
    assert media.epochs_of(files).count() == 3  # 2.4 s
    frames, sound = media.decode_media(media.scan(files), media.streams_of(files))
    assert frames.count() == 0 and [s for r in sound.orderBy("pts").collect() for s in r.samples] == [s for r in pcm.orderBy("seq").collect() for s in r.samples]


def test_y4m_files(spark, tmp_path):
    for r in y4m.files(plans.clips(spark, SF, 3)).collect():
        (tmp_path / f"{r.file_id}.y4m").write_bytes(bytes(r.content))
    (tmp_path / "bad.y4m").write_bytes(b"nothing")
    got = y4m.read(spark, str(tmp_path)).collect()
    assert sum(r.error_code is None for r in got) == 18 and [r.error_code for r in got if r.clip_id == "bad.y4m"] == ["BadHeader"]


def test_y4m_source_and_sink(spark, tmp_path):
    """Runs of frames are read apart; files that the sink writes are those of the value form; bad ones are rows."""
    c = plans.clips(spark, SF, 5)
    y4m.save(c, str(tmp_path))
    assert {p.name.removesuffix(".y4m"): p.read_bytes() for p in tmp_path.glob("*.y4m")} == {r.file_id: bytes(r.content) for r in y4m.files(c).collect()}
    (tmp_path / "bad.y4m").write_bytes(b"nothing")
    (tmp_path / "short.y4m").write_bytes((tmp_path / "pan.y4m").read_bytes()[:-7])
    (tmp_path / "words.y4m").write_bytes((tmp_path / "ui.y4m").read_bytes().replace(b"FRAME\n", b"FRAME Ip\n"))
    got = y4m.load(spark, str(tmp_path), read_bytes="5000")
    rows = got.collect()
    assert got.rdd.getNumPartitions() == 6 * 3 + 3  # five frames of 2310 bytes in runs of two; odd files whole
    want = {(r.clip_id, r.frame_index, bytes(r.y), bytes(r.v)) for r in c.collect()}
    good = {(r.clip_id, r.frame_index, bytes(r.y), bytes(r.v)) for r in rows if not r.error_code}
    assert want <= good and {(f, i) for f, i, *_ in good - want} == {("words", i) for i in range(5)}
    assert {r.clip_id: r.error_code for r in rows if r.error_code} == {"bad": "BadHeader", "short": "UnexpectedEof"}


def run_stream(spark, folder, batches, schema=FRAGMENTS, parse=parse_stream):
    """Each batch of fragments is one micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        with plans.setting(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
            parse(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out").collect()


def test_epoch_ranges(spark, tmp_path):
    """Each epoch's range is a stream of its own, keyed by file and epoch; another epoch's bytes are rejected."""
    data = small_file()
    cut = lambda name, e, part, size=300: [(name, 0, i // size, bytearray(part[i : i + size]), i + size >= len(part), e) for i in range(0, len(part), size)]
    ranges = {e.id: data[e.offset : e.offset + e.length] for e in wire.parse_prefix(data).epochs}
    rows = [r for e, part in ranges.items() for r in cut("a", e, part)] + cut("b", 1, ranges[2])
    got = run_stream(spark, str(tmp_path), [rows[::2], rows[1::2]], RANGES, parse_ranges)
    want = [(e, p.pts, bytes(p.payload)) for e, part in ranges.items() for _, p in wire.scan(part)]
    assert sorted((r.epoch_id, int(r.pts), bytes(r.payload)) for r in got if r.file_id == "a") == sorted(want)
    assert [r.error_code for r in got if r.file_id == "b"] == ["BadEpoch"]


def test_stream_state_over_batches(spark, tmp_path):
    data = small_file()
    cut = lambda name, gen, size: [(name, gen, i // size, bytearray(data[i : i + size]), i + size >= len(data)) for i in range(0, len(data), size)]
    a, b = cut("a", 0, 500), cut("b", 0, 300)
    stale, fresh = cut("c", 1, 400), cut("c", 2, 450)
    half = len(a) // 2
    got = run_stream(spark, str(tmp_path), [a[:half] + b + stale[:1], a[half:] + fresh[:1], stale[1:] + fresh[1:]])
    by = {f: sorted((r.seq, r.kind, r.generation) for r in got if r.file_id == f and r.generation != 1) for f in "abc"}
    early = [r.seq for r in got if r.generation == 1]  # what the stale generation's first fragment held; its later ones are ignored
    assert len(early) < 5
    assert [k for _, k, _ in by["a"]] == [k for _, k, _ in by["b"]] == [k for _, k, _ in by["c"]] and len(by["a"]) == 15
    assert {g for _, _, g in by["c"]} == {2} and not any(r.error_code for r in got)
    assert os.path.isdir(f"{tmp_path}/state")


def test_encoding_in_a_stream(spark, tmp_path):
    """Frames in shuffled micro-batches give the packets of the batch encoder, epoch by epoch."""
    import random

    from tessera.streaming.encode import FRAMES_IN, PACKETS_OUT, encode_stream

    clips = spark.createDataFrame(plans.clips(spark, SF, 8).where("clip_id IN ('pan', 'cut')").drop("error_code").collect())
    want = {(r.file_id, r.epoch_id, r.seq, bytes(r.payload)) for r in media.encode_video(media.epochs_by_cut(clips, 3), 1, plans.FRAME_US, 48, "fast").collect()}
    rows = [(r.clip_id, r.frame_index, r.width, r.height, r.y, r.u, r.v) for r in clips.collect()]
    random.Random(3).shuffle(rows)
    for part in (rows[:7], rows[7:], rows[:2]):
        spark.createDataFrame(part, FRAMES_IN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with plans.setting(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
            out = encode_stream(spark.readStream.schema(FRAMES_IN).parquet(f"{tmp_path}/in"), 1, plans.FRAME_US, 48, "fast", 3, True)
            out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(PACKETS_OUT).parquet(f"{tmp_path}/out").collect()
    assert {(r.file_id, r.epoch_id, r.seq, bytes(r.payload)) for r in got} == want and len(got) == len(want) == 16
    assert all(int(r.pts) == r.seq * plans.FRAME_US and r.error_code is None for r in got)
