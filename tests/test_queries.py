"""Every registered query against its SQL, and the rows-only ones for what they promise."""

import math

import duckdb
import pytest

from tessera.plans import registered
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTERED = registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTERED.items() if sql])
def test_against_sql(spark, duck, name):
    query, sql = REGISTERED[name]
    df = query(spark, SF)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def result(spark, name):
    return REGISTERED[name][0](spark, SF).collect()


def test_crc32c_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = result(spark, "crc32c_texts")
    assert len(got) == len(texts)
    for r in got[:40]:
        s = 0xFFFFFFFF
        for b in texts[r.doc_id].encode()[:]:
            s ^= b
            for _ in range(8):
                s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
        assert s ^ 0xFFFFFFFF == r.crc32c


def test_round_trips(spark):
    assert all(r.exact and r.coded_bytes <= r.raw_bytes + 5 for r in result(spark, "entropy_roundtrip"))
    audio = result(spark, "audio_roundtrip")
    assert all(r.exact and r.snr_db is None for r in audio if r.q == 1) and all(r.snr_db > 20 for r in audio if r.q > 1)
    video = result(spark, "video_roundtrip")
    assert {r.clip_id for r in video} == {"cut", "pan", "ui", "gradient", "noise", "chroma"} and sum(r.frames for r in video) == 72
    assert all(r.psnr_db > 35 for r in video)
    assert all(r.exact and r.frames == 12 for r in result(spark, "y4m_roundtrip"))


def test_containers(spark):
    got = {(r.file_id.removesuffix(".bin"), r.kind): r for r in result(spark, "container_scan")}
    assert all(r.rejected == 0 for r in got.values())
    assert all(got[c, k].n == 12 for c in ("cut", "pan", "noise") for k in ("video", "audio"))
    assert got["cut", "epoch"].n >= 2
    frames = result(spark, "container_frames")
    assert len(frames) == 72 and all(r.q == 48 and r.stream_count == 2 for r in frames)
    assert all(r.error_code is None and r.streams == 2 for r in result(spark, "inspect_files"))
    assert all(r.strict_error is not None and r.error_code is None and r.dropped >= 1 and r.epochs >= 1 for r in result(spark, "repair_files"))


def test_encode_decode_and_rules(spark):
    got = result(spark, "encode_and_decode")
    assert len(got) == 6 and all(r.frames == 12 and r.rejected == 0 and r.packets == 25 and r.samples == 25 * 960 for r in got)  # 0.5 s of 0.7 s
    bad = {(r.file_id, r.rule) for r in result(spark, "file_violations")}
    assert bad and all(f.endswith(("-short", "-flip")) for f, _ in bad)
    assert {("cut-short", "range_outside_file"), ("cut-short", "packet:UnexpectedEof"), ("cut-flip", "packet:PayloadChecksum")} <= bad
    sizes = {(r.clip_id, r.q): r.bytes for r in result(spark, "rate_quality")}
    assert all(sizes[c, 1] > sizes[c, 192] for c in ("noise", "pan", "gradient"))
    e = {(r.clip_id, r.experiment, r.measure): r.value for r in result(spark, "format_experiments")}
    assert e["ui", "block_copy", "repeated"] > 0 and e["noise", "deblock", "sse_32"] > 0


def test_pcm_bytes(spark):
    from tessera.operators.media import pcm_bytes

    df = spark.createDataFrame([("a", 2, 0, [0, 1, -1, 32767, -32768])], "file_id string, stream_id int, pts int, samples array<short>")
    assert bytes(pcm_bytes(df).first().s16le) == b"\x00\x00\x01\x00\xff\xff\xff\x7f\x00\x80"


def test_seek_and_stream_decode(spark):
    """Decoding within the stream gives the frames and samples of the scan, and a seek gives their last part."""
    from pyspark.sql import functions as F

    from tessera.operators import media
    from tessera.plans import media as plans

    files = plans.encoded_clips(spark, SF)
    r = media.route(media.scan(files), media.streams_of(files))
    frames = media.decode_video(r).select("file_id", "epoch_id", F.lit("video_frame").alias("kind"), F.col("pts").cast("string").alias("pts"), "y", "u", "v", F.lit(None).cast("array<int>").alias("samples"))
    sound = media.decode_audio(r).select("file_id", "epoch_id", F.lit("audio_frame").alias("kind"), F.col("pts").cast("string").alias("pts"), *(F.lit(None).cast("binary").alias(c) for c in "yuv"), F.col("samples").cast("array<int>").alias("samples"))
    both = frames.unionByName(sound).groupBy("file_id", "epoch_id", "kind").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pts", "y", "u", "v", "samples")).alias("digest"))
    want = {(x.file_id, x.epoch_id, x.kind, x.n, x.digest) for x in both.collect()}
    got = result(spark, "stream_decode")
    assert not any(x.error_code for x in got)
    assert {(x.file_id, x.epoch_id, x.kind, x.n, x.digest) for x in got if x.kind != "epoch_start"} == want
    seek = {x.file_id.removesuffix(".bin"): x for x in result(spark, "seek_decode")}
    assert len(seek) == 6 and all(0 < x.frames < 12 and x.first_pts <= 333_333 and not x.rejected for x in seek.values())


def test_stream_equals_scan(spark):
    streamed = {(r.file_id, r.kind): r.n for r in result(spark, "stream_parse")}
    assert not any(r.error_code for r in result(spark, "stream_parse"))
    scanned = {(r.file_id.removesuffix(".bin"), r.kind): r.n for r in result(spark, "container_scan")}
    assert {k: v for k, v in streamed.items() if k[1] == "video_frame"} == {(f, "video_frame"): n for (f, k), n in scanned.items() if k == "video"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_bytes_are_counted_in_pieces():
    """One batch a task whatever it reads, and memory that does not follow the size of a batch."""
    import tracemalloc

    import pyarrow as pa

    from tessera.plans.packets import counted_bytes

    texts = pa.RecordBatch.from_arrays([pa.array([b"ab" * (1 << 20)] * 16, pa.binary())], names=["t"])
    tracemalloc.start()
    out = list(counted_bytes(iter([texts.slice(1, 7), texts.slice(8)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.to_pydict() for b in out] == [{"symbol": [97, 98], "n": [15 << 20] * 2}]
    assert peak < 16 << 20


def test_coding_keeps_its_tasks(spark):
    """Few bytes that take long to code are not joined into one task; what violations read is coded once and read from files."""
    from tessera.operators import media
    from tessera.plans.clips import clips

    packets = media.encode_video(media.epochs_by_cut(clips(spark, SF), 6), 1, 41_666, 48, "fast")
    assert packets.rdd.getNumPartitions() == 4
    assert "FlatMapGroupsInArrow" not in REGISTERED["file_violations"][0](spark, SF)._jdf.queryExecution().toString()
    assert str(REGISTERED["encode_and_decode"][0](spark, SF)._jdf.queryExecution().optimizedPlan()).count("FlatMapGroupsInArrow") == 1
