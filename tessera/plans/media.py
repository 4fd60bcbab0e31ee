"""Queries that SQL cannot express: checksums, entropy blocks, codecs, containers, streaming; tests hold them against second implementations."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checksum import crc32c_many, table as crc_table
from tessera.llm.store import bounded_batches, written
from tessera.operators import audio, lanes, media, wire
from tessera.sources import container, y4m

from .carriers import blocks, read
from .clips import FRAMES, HEIGHT, WIDTH, clips
from .clips import SQL as CLIPS

FRAME_US = 41_666


def shared(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only in local mode, where that is unset, a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    out = f"{root.rstrip('/')}/media/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return out


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def crc32c_texts(spark, sf):
    """CRC-32C of every text's bytes, a batch of texts at a time."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc32c_many(b.column(1)), pa.int64())], names=["doc_id", "crc32c"])

    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    bounded_batches(spark)
    return d.mapInArrow(run, "doc_id long, crc32c long")


_STEP = f"xor([{', '.join(map(str, crc_table().tolist()))}][(xor(s, b) & 255) + 1], s >> 8)"
CRC32C_TEXTS = f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(list_concat([4294967295], bytes), lambda s, b: {_STEP}), 4294967295) AS crc32c FROM d"""


def entropy_roundtrip(spark, sf):
    """Entropy blocks (of at most MAX_ENTROPY bytes) of all documents' texts: sizes, mode and whether they come back."""

    def run(batches):
        for b in batches:
            cut = [(i, k, x[at : at + wire.MAX_ENTROPY]) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, at in enumerate(range(0, max(len(x), 1), wire.MAX_ENTROPY))]
            got = [(*c, coded) for c, coded in zip(cut, lanes.compress_many([x for *_, x in cut]), strict=True)]
            cols = [[i for i, *_ in got], [k for _, k, *_ in got], [len(x) for *_, x, _ in got], [len(c) for *_, c in got], [c[0] for *_, c in got]]
            exact = pa.array([y == x for (*_, x, _), y in zip(got, lanes.decompress_many([c for *_, c in got], wire.MAX_ENTROPY), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), exact], names=["doc_id", "block", "raw_bytes", "coded_bytes", "mode", "exact"])

    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    bounded_batches(spark)
    return d.mapInArrow(run, "doc_id long, block long, raw_bytes long, coded_bytes long, mode long, exact boolean")


def audio_roundtrip(spark, sf):
    """Blocks as mono packets at two quantisers: sizes, signal to noise, exactness."""

    def run(batches):
        for b in batches:
            out = []
            for v, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pcm = np.clip(np.array(x), -32768, 32767).astype(np.int16)
                for q in (1, 96):
                    p = audio.encode(pcm, 48_000, 1, q)
                    back = audio.decode(p)[2]
                    snr = audio.snr_db(pcm, back)
                    out.append((v, q, len(p), None if snr == float("inf") else round(snr, 6), bool((back == pcm).all())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["vec_id", "q", "packet_bytes", "snr_db", "exact"])

    return blocks(spark, sf).select("vec_id", "x").mapInArrow(run, "vec_id long, q long, packet_bytes long, snr_db double, exact boolean")


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: what several steps read is made once, not again for each of them."""
    return written(df, f"{shared(df.sparkSession)}/rows")


def video_stream() -> wire.Stream:
    return wire.Stream(1, 1, 1, wire.TIMESCALE, WIDTH, HEIGHT, 24 << 16 | 1)


def audio_stream(channels: int = 2) -> wire.Stream:
    return wire.Stream(2, 2, 1, wire.TIMESCALE, 48_000, channels)


def encoded_packets(spark: SparkSession, sf: str, q: int = 48, preset: str = "fast", every: int = 6) -> tuple[DataFrame, list[wire.Stream]]:
    """Packets of the clips and their streams: video by scene-cut epochs, and stereo sound of the clips' own samples."""
    frames = kept(media.epochs_by_cut(clips(spark, sf), every))
    packets = media.encode_video(frames, 1, FRAME_US, q, preset)
    byte = lambda k: F.conv(F.hex(F.expr("substring(y, 1, 481)").substr(k + 1, F.lit(1))), 16, 10).cast("int")
    sample = lambda k: byte(k) * 200 - 25_600
    pcm = frames.select(F.col("clip_id").alias("file_id"), "epoch_id", F.col("frame_index").alias("seq"), (F.col("frame_index") * 1999).alias("first_frame"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(479)), lambda k: F.array(sample(k), sample(k + 1)))).cast("array<short>").alias("samples"), "y")
    return packets.unionByName(media.encode_audio(pcm, 2, 48_000, 2, 1, True)), [video_stream(), audio_stream()]


def encoded_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Whole container files of the clips, as values."""
    return media.mux(*encoded_packets(spark, sf))


def saved_clips(spark: SparkSession, sf: str, q: int = 48) -> str:
    """A shared folder of container files of the clips, written by the sink epoch by epoch."""
    root = shared(spark)
    container.save(media.mux_epochs(*encoded_packets(spark, sf, q)), root)
    return root


def video_roundtrip(spark, sf):
    """Clips encoded and decoded: packet bytes and PSNR of every clip and epoch."""
    frames = kept(media.epochs_by_cut(clips(spark, sf), 6))
    packets = kept(media.encode_video(frames, 1, FRAME_US, 48, "balanced"))
    routed = packets.select("file_id", "seq", "epoch_id", "kind", "stream_id", "pts", "payload", F.lit(WIDTH).alias("param0"), F.lit(HEIGHT).alias("param1"), "error_code")
    out = media.decode_video(routed).withColumnRenamed("file_id", "clip_id")
    source = frames.select("clip_id", F.col("frame_index").cast("decimal(20,0)").alias("frame_id"), *(F.col(c).alias(f"s{c}") for c in "yuv"))

    def run(batches):
        for b in batches:
            err = [sum(int(((np.frombuffer(r[f"s{c}"], np.uint8).astype(int) - np.frombuffer(r[c], np.uint8)) ** 2).sum()) for c in "yuv") for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), b.column("epoch_id"), pa.array(err, pa.int64())], names=["clip_id", "epoch_id", "sse"])

    errors = out.join(source, ["clip_id", "frame_id"]).mapInArrow(run, "clip_id string, epoch_id long, sse long")
    n = WIDTH * HEIGHT * 3 // 2
    psnr = errors.groupBy("clip_id", "epoch_id").agg(F.count("*").alias("frames"), F.round(10 * F.log10(65025.0 * n * F.count("*") / F.greatest(F.sum("sse"), F.lit(1))), 6).alias("psnr_db"))
    size = packets.groupBy(F.col("file_id").alias("clip_id"), "epoch_id").agg(F.sum(F.octet_length("payload")).alias("bytes"))
    return psnr.join(size, ["clip_id", "epoch_id"])


def container_scan(spark, sf):
    """Encode, write, then scan epoch by epoch through the data source, route and verify by full decode."""
    root = saved_clips(spark, sf)
    return media.verify(container.load(spark, root), container.load(spark, root, "streams"))


def container_frames(spark, sf):
    """The frame listing of scanned containers."""
    root = saved_clips(spark, sf)
    return media.frame_list(container.load(spark, root)).join(container.load(spark, root, "files").select("file_id", "stream_count"), "file_id")


def media_counts(spark, sf):
    """Epochs, frames and times of every file, from its index and its packets."""
    root = saved_clips(spark, sf)
    name = F.regexp_replace("file_id", r"\.bin$", "").alias("clip_id")
    epochs = container.load(spark, root, "epochs").groupBy(name).agg(F.count("*").alias("epochs"))
    frames = media.frame_list(container.load(spark, root)).groupBy(name).agg(F.count("*").alias("frames"), F.min("pts").cast("long").alias("first_pts"), F.max("pts").cast("long").alias("last_pts"), F.count_if(F.col("q") != 48).alias("odd"))
    return epochs.join(frames, "clip_id")


MEDIA_COUNTS = f"""WITH {CLIPS},
d AS (SELECT a.clip_id, a.t, sum(abs(a.y - b.y)) // count(*) AS d FROM luma_ a JOIN luma_ b ON a.clip_id = b.clip_id AND a.i = b.i AND a.t = b.t + 1 GROUP BY ALL)
SELECT clip_id, 1 + count(*) FILTER (t % 6 = 0 OR d > 48) AS epochs, 1 + count(*) AS frames, 0 AS first_pts, {(FRAMES - 1) * FRAME_US} AS last_pts, 0 AS odd FROM d GROUP BY clip_id"""


def _sums(frames: DataFrame) -> DataFrame:
    """Sums of the planes of (clip_id, frame, y, u, v), plain and by place."""

    def run(batches):
        for b in batches:
            sums = []
            for c in "yuv":
                planes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in b.column(c).to_pylist()]
                sums += [[int(p.sum()) for p in planes], [int((p * np.arange(1, len(p) + 1)).sum()) for p in planes]]
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), b.column("frame"), *(pa.array(s, pa.int64()) for s in sums)], names=["clip_id", "frame", *(f"{k}_{c}" for c in "yuv" for k in ("sum", "place"))])

    return frames.mapInArrow(run, "clip_id string, frame long, " + ", ".join(f"{k}_{c} long" for c in "yuv" for k in ("sum", "place")))


def lossless_frames(spark, sf):
    """Clips coded without loss, written, scanned by splits and decoded by plane: sums of every frame's planes, plain and by place."""
    root = saved_clips(spark, sf, 1)
    frames, _ = media.decode_media(container.load(spark, root), container.load(spark, root, "streams"), by_plane=True)

    slim = frames.where("error_code IS NULL").select(F.regexp_replace("file_id", r"\.bin$", "").alias("clip_id"), F.col("frame_id").cast("long").alias("frame"), "y", "u", "v")
    return _sums(slim)


LOSSLESS_FRAMES = f"""WITH {CLIPS},
a AS (SELECT clip_id, t, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(y * (i + 1)) AS BIGINT) AS place_y FROM luma_ GROUP BY ALL),
b AS (SELECT clip_id, t, CAST(sum(u) AS BIGINT) AS sum_u, CAST(sum(u * (i + 1)) AS BIGINT) AS place_u, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * (i + 1)) AS BIGINT) AS place_v FROM chroma_ GROUP BY ALL)
SELECT clip_id, t AS frame, sum_y, place_y, sum_u, place_u, sum_v, place_v FROM a JOIN b USING (clip_id, t)"""


def stream_lossless(spark, sf):
    """Frames in, in three micro-batches, to containers out within one stream, and from these within another to frames again: sums of every frame's planes."""
    from tessera.streaming.encode import FRAMES_IN, encode_epochs
    from tessera.streaming.packets import DECODED, PROVIDER, decode_stream

    root = shared(spark)
    c = clips(spark, sf).select("clip_id", "frame_index", "width", "height", "y", "u", "v", (F.col("frame_index") == FRAMES - 1).alias("last"))
    c.repartition(3, "frame_index").write.parquet(f"{root}/frames")
    frames = spark.readStream.schema(FRAMES_IN + ", last boolean").option("maxFilesPerTrigger", 1).parquet(f"{root}/frames")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
        epochs = encode_epochs(frames, 1, FRAME_US, 1, "fast", 6, True)
        container.sink(epochs, f"{root}/containers", f"{root}/encode").trigger(availableNow=True).start().awaitTermination()
    got = _streamed(spark, root, lambda: decode_stream(container.stream(spark, f"{root}/containers", fragment_bytes="4096")), DECODED)
    return _sums(got.where("kind = 'video_frame' AND error_code IS NULL").select(F.regexp_replace("file_id", r"\.\d{8}\.bin$", "").alias("clip_id"), F.col("frame_id").cast("long").alias("frame"), "y", "u", "v"))


def seek_decode(spark, sf):
    """Frames and samples from the epoch of a third of a second on: only that byte range of each file is read."""
    root = saved_clips(spark, sf)
    frames, sound = container.play(spark, root, 333_333)
    f = frames.groupBy("file_id").agg(F.count("*").alias("frames"), F.min("pts").alias("first_pts"), F.count("error_code").alias("rejected"))
    return f.join(sound.groupBy("file_id").agg(F.sum(F.size("samples")).alias("samples")), "file_id")


def inspect_files(spark, sf):
    """Epochs of the written containers from their indexes alone."""
    from tessera.commands import inspect

    return inspect(spark, saved_clips(spark, sf))


def damaged(spark: SparkSession, folder: str, to: str) -> None:
    """Copies of the container files of a folder with four bytes overwritten at two thirds of each, made in tasks a piece at a time."""
    from tessera.sources.files import file_system, listed

    _, names = listed(folder)

    def run(batches):
        (fs, _), (out, base) = file_system(folder), file_system(to)
        out.create_dir(base, recursive=True)
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut, at = size * 2 // 3, 0
                with fs.open_input_stream(name) as f, out.open_output_stream(f"{base}/{name.rpartition('/')[2]}") as g:
                    while piece := bytearray(f.read(1 << 20)):
                        for k in range(max(cut - at, 0), min(cut + 4 - at, len(piece))):
                            piece[k] = (0xEE, 0x11)[(at + k - cut) % 2]
                        at += len(piece)
                        g.write(bytes(piece))
            yield b

    spark.createDataFrame(names, "name string, size long").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "name string, size long").write.format("noop").mode("overwrite").save()


def repair_files(spark, sf):
    """Files with four bytes overwritten: strict reindexing rejects them; repair, by byte ranges, drops what they hit and writes new files."""
    from tessera.sources.resync import Resync

    bad, fixed = shared(spark), shared(spark)
    damaged(spark, saved_clips(spark, sf), bad)
    r = Resync(spark, bad, shared(spark))
    r.save(fixed)
    sizes = container.load(spark, fixed, "files").select(F.regexp_replace("file_id", r"\.bin$", "").alias("file_id"), "bytes")
    name = F.regexp_replace("file_id", r"\.bin$", "").alias("file_id")
    strict = r.outcome(False).select(name, F.col("error_code").alias("strict_error"))
    return strict.join(r.outcome().select(name, "epochs", "dropped", "error_code"), "file_id").join(sizes, "file_id", "left")


def y4m_roundtrip(spark, sf):
    """Generated clips as Y4M files and back: frames and whether each is the same."""
    c = kept(clips(spark, sf))
    root = shared(spark)
    y4m.save(c, root)
    back = y4m.load(spark, root)
    same = F.every((F.col("a.y") == F.col("b.y")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")))
    return c.alias("a").join(back.alias("b"), ["clip_id", "frame_index"]).groupBy("clip_id").agg(F.count("*").alias("frames"), same.alias("exact"))


def _fragments(spark: SparkSession, sf: str, root: str, size: int = 700) -> DataFrame:
    """The generated files as a stream of fragments, a part of them in each micro-batch."""
    from tessera.streaming.packets import FRAGMENTS

    n = F.ceil(F.octet_length("content") / size).cast("int")
    parts = encoded_clips(spark, sf).select("file_id", "content", n.alias("n")).select("file_id", "content", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    frag = parts.select("file_id", F.lit(0).cast("long").alias("generation"), F.col("part").cast("long").alias("part"), F.expr(f"substring(content, part * {size} + 1, {size})").alias("data"), (F.col("part") == F.col("n") - 1).alias("last"))
    frag.repartition(3).write.parquet(f"{root}/fragments")
    return spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/fragments")


def _streamed(spark: SparkSession, root: str, build, schema: str) -> DataFrame:
    """What a streaming query gives for all that is there, by way of a Parquet sink."""
    from tessera.streaming.packets import PROVIDER

    with setting(spark, "spark.sql.streaming.stateStore.providerClass", PROVIDER):
        q = build().writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


def stream_parse(spark, sf):
    """Files cut into fragments and parsed by a stateful stream: packets of each file and kind."""
    from tessera.streaming.packets import OUT, parse_stream

    root = shared(spark)
    stream = _fragments(spark, sf, root)
    return _streamed(spark, root, lambda: parse_stream(stream), OUT).groupBy("file_id", "kind", "error_code").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


def stream_decode(spark, sf):
    """Files cut into fragments and decoded within the stream: frames and samples of each file and epoch, with a digest of them."""
    from tessera.streaming.packets import DECODED, decode_stream

    root = shared(spark)
    stream = _fragments(spark, sf, root)
    out = _streamed(spark, root, lambda: decode_stream(stream), DECODED)
    digest = F.bit_xor(F.xxhash64("pts", "y", "u", "v", "samples"))
    return out.groupBy("file_id", "epoch_id", "kind", "error_code").agg(F.count("*").alias("n"), F.sum(F.size("samples")).alias("samples"), digest.alias("digest"))


def format_experiments(spark, sf):
    """Transform skip, block copy, motion merge, deblocking and entropy lanes on the generated clips."""
    from tessera.operators.research import experiments

    return experiments(clips(spark, sf))


def rate_quality(spark, sf):
    """Bytes of each clip by quantiser."""
    frames = kept(media.epochs_by_cut(clips(spark, sf), 6))
    out = None
    for q in (1, 48, 192):
        size = media.encode_video(frames, 1, FRAME_US, q, "fast").groupBy(F.col("file_id").alias("clip_id")).agg(F.sum(F.octet_length("payload")).alias("bytes")).withColumn("q", F.lit(q))
        out = size if out is None else out.unionByName(size)
    return out


def encode_and_decode(spark, sf):
    """A clip with sound through encode_av, scan and decode: frames, samples, and packets of the audio dropped at the end."""
    c = kept(clips(spark, sf))
    n = F.sequence(F.lit(0), F.lit(34))
    pcm = c.select("clip_id").distinct().select("clip_id", F.explode(n).alias("k")).select("clip_id", F.col("k").cast("long").alias("seq"), (F.col("k") * 960).cast("long").alias("first_frame"), F.transform(F.sequence(F.lit(0), F.lit(959)), lambda i: (F.pmod(i * 31 + F.col("k"), F.lit(2000)) - 1000).cast("short")).alias("samples"))
    files = kept(media.encode_av(c, pcm, 48_000, 1, (24, 1), 6, 1, "fast"))
    frames, sound = media.decode_media(kept(media.scan(files)), kept(media.streams_of(files)))
    f = frames.groupBy("file_id").agg(F.count("*").alias("frames"), F.count("error_code").alias("rejected"))
    s = sound.groupBy("file_id").agg(F.count("*").alias("packets"), F.sum(F.size("samples")).alias("samples"), F.min("pts").alias("first_pts"))
    return f.join(s, "file_id")


def file_violations(spark, sf):
    """Broken rules of good files, of a truncated copy and of one with a flipped byte."""
    good = kept(encoded_clips(spark, sf))
    short = good.select(F.concat("file_id", F.lit("-short")).alias("file_id"), F.expr("substring(content, 1, octet_length(content) - 9)").alias("content"))
    flip = good.select(F.concat("file_id", F.lit("-flip")).alias("file_id"), F.concat(F.expr("substring(content, 1, octet_length(content) - 9)"), F.lit(b"x"), F.expr("substring(content, octet_length(content) - 7)")).alias("content"))
    files = good.select("file_id", "content").unionByName(short).unionByName(flip)
    sizes = files.select("file_id", F.octet_length("content").alias("file_bytes"))
    packets = kept(media.scan(files).drop("payload"))
    return media.violations(packets, kept(media.streams_of(files)), kept(media.epochs_of(files)), sizes).groupBy("file_id", "rule").agg(F.count("*").alias("n"))


_ALL = (crc32c_texts, entropy_roundtrip, audio_roundtrip, video_roundtrip, container_scan, container_frames, seek_decode, inspect_files, repair_files, y4m_roundtrip, stream_parse, stream_decode, format_experiments, rate_quality, encode_and_decode, file_violations)
QUERIES = {f.__name__: (f, None) for f in _ALL} | {"crc32c_texts": (crc32c_texts, CRC32C_TEXTS), "media_counts": (media_counts, MEDIA_COUNTS), "lossless_frames": (lossless_frames, LOSSLESS_FRAMES), "stream_lossless": (stream_lossless, LOSSLESS_FRAMES)}
