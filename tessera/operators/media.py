"""Spark operators over containers: scan, inspect, verify, list, decode, encode, mux, reindex and repair.

Audio packets stand alone and are coded row by row; video is coded by group of (file, epoch,
stream), the span within which frames refer to each other. Groups are bounded by an epoch. A
rejected packet yields an error_code and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import audio, video, wire
from .errors import Rejected

_PACKET_FIELDS = "file_id string, seq long, byte_offset long, epoch_id long, kind string, stream_id int, pts decimal(20,0), duration long, payload binary, error_code string"
PACKETS = _PACKET_FIELDS
FRAMES = "file_id string, epoch_id long, stream_id int, pts decimal(20,0), frame_id decimal(20,0), width int, height int, y binary, u binary, v binary, error_code string"
#: Bytes of decoded frames that are handed on together.
FRAME_BYTES = 8 << 20
PCM = "file_id string, epoch_id long, stream_id int, pts decimal(20,0), rate int, channels int, samples array<short>, error_code string"


def u64(v: int | None) -> Decimal | None:
    return None if v is None else Decimal(v)


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "decimal(20,0)": pa.decimal128(20, 0), "binary": pa.binary(), "array<short>": pa.list_(pa.int16()), "double": pa.float64()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (f.rsplit(" ", 1) for f in ddl.split(", "))])


def _rows(df: DataFrame, ddl: str, one: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """mapInArrow from rows as dictionaries to rows of a schema, a batch at a time."""
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                out.extend(one(r))
                if len(out) >= 256:
                    yield table(out, schema)
                    out = []
            yield table(out, schema)

    return df.mapInArrow(run, ddl)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many tasks as the session shuffles to: coding takes long over few bytes, by which adaptive execution would join the tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def scan_rows(file_id: str, data: bytes, at: int, end: int, epoch: int | None, seq: int = 0, tracked: bool = True) -> Iterator[tuple]:
    """Packet rows of a byte range; the first bad packet gives a row with an error_code and ends it."""
    tracker = wire.EpochTracker(epoch)
    while at < end:
        try:
            p = wire.decode_packet(data[:end] if end < len(data) else data, at)
            current = tracker.observe(p) if tracked else epoch
        except Rejected as e:
            yield file_id, seq, at, tracker.current, None, None, None, None, None, e.code
            return
        yield file_id, seq, at, current, wire.PACKET_KINDS[p.kind], p.stream_id, u64(p.pts), p.duration, p.payload, None
        at, seq = at + p.size, seq + 1


def scan(files: DataFrame, magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    """All packets of files (file_id, content), in file order; a bad prefix is one row with an error_code."""

    def one(r: dict) -> Iterator[tuple]:
        try:
            prefix = wire.parse_prefix(r["content"], magic)
        except Rejected as e:
            yield r["file_id"], 0, 0, None, None, None, None, None, None, e.code
            return
        yield from scan_rows(r["file_id"], r["content"], prefix.length, len(r["content"]), None)

    return _rows(files.select("file_id", "content"), PACKETS, one)


STREAMS = "file_id string, stream_id int, kind string, codec int, timescale long, param0 long, param1 long, flags long, meta0 long"
EPOCHS = "file_id string, epoch_id long, pts decimal(20,0), byte_offset decimal(20,0), byte_len decimal(20,0), duration long"


def stream_rows(file_id: str, p: wire.Prefix) -> list[tuple]:
    return [(file_id, s.id, wire.STREAM_KINDS[s.kind], s.codec, s.timescale, s.param0, s.param1, s.flags, s.meta0) for s in p.streams]


def epoch_rows(file_id: str, p: wire.Prefix) -> list[tuple]:
    return [(file_id, e.id, u64(e.pts), u64(e.offset), u64(e.length), e.duration) for e in p.epochs]


def streams_of(files: DataFrame, magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    return _rows(files.select("file_id", "content"), STREAMS, lambda r: iter(stream_rows(r["file_id"], _prefix(r["content"], magic))))


def epochs_of(files: DataFrame, magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    return _rows(files.select("file_id", "content"), EPOCHS, lambda r: iter(epoch_rows(r["file_id"], _prefix(r["content"], magic))))


def _prefix(data: bytes, magic: bytes) -> wire.Prefix:
    try:
        return wire.parse_prefix(data, magic)
    except Rejected:
        return wire.Prefix(0)


def inspect(files: DataFrame, magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    """Epochs of every file with the stream count and whether their range lies inside the file."""
    sizes = files.select("file_id", F.octet_length("content").alias("file_bytes"))
    n = streams_of(files, magic).groupBy("file_id").agg(F.count("*").alias("streams"))
    inside = F.col("byte_offset") + F.col("byte_len") <= F.col("file_bytes")
    return epochs_of(files, magic).join(sizes, "file_id").join(n, "file_id", "left").select("file_id", "streams", "epoch_id", "pts", "byte_offset", "byte_len", "duration", F.when(~inside, "BadFront").alias("error_code"))


def byte_value(payload: Column | str, at: int, n: int) -> Column:
    """An unsigned little-endian integer inside a binary column."""
    part = F.reverse(F.expr(f"substring({payload}, {at + 1}, {n})")) if n == 1 else F.concat(*(F.expr(f"substring({payload}, {at + k}, 1)") for k in range(n, 0, -1)))
    return F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")


def frame_list(packets: DataFrame) -> DataFrame:
    """Stream, frame id, pts, quantiser, references and size of every video frame, from header bytes alone."""
    ok = (F.col("kind") == "video_frame") & (F.octet_length("payload") >= 20) & (F.expr("substring(payload, 1, 4)") == F.lit(video.MAGIC))
    return packets.where(ok).select("file_id", "stream_id", byte_value("payload", 4, 8).alias("frame_id"), "pts", byte_value("payload", 16, 2).cast("int").alias("q"), byte_value("payload", 18, 1).cast("int").alias("refs"), (F.octet_length("payload") + wire.PACKET_HEAD + wire.PACKET_TAIL).alias("packet_bytes"))


def route(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets with their stream's parameters; media without a stream of their kind gets BadStream.

    Descriptors are a few rows a file and join by file and stream; Spark picks the strategy by their size.
    """
    s = streams.select("file_id", "stream_id", F.col("kind").alias("stream_kind"), "codec", "param0", "param1")
    j = packets.join(s, ["file_id", "stream_id"], "left")
    media = F.col("kind").isin("video_frame", "audio_frame")
    fits = (F.col("kind") == F.concat("stream_kind", F.lit("_frame"))) & (F.col("codec") == 1)
    return j.withColumn("error_code", F.coalesce("error_code", F.when(media & ~F.coalesce(fits, F.lit(False)), F.lit("BadStream"))))


def decode_audio(routed: DataFrame) -> DataFrame:
    """Samples of every audio packet that ``route`` let through."""

    def one(r: dict) -> Iterator[tuple]:
        key = r["file_id"], r["epoch_id"], r["stream_id"], r["pts"]
        try:
            rate, channels, pcm = audio.decode(r["payload"])
            if (rate, channels) != (r["param0"], r["param1"]):
                raise Rejected("BadStream")
        except Rejected as e:
            yield *key, None, None, None, e.code
            return
        yield *key, rate, channels, pcm.tolist(), None

    return _rows(routed.where("kind = 'audio_frame' AND error_code IS NULL"), PCM, one)


def decode_video(routed: DataFrame) -> DataFrame:
    """Frames of every epoch and stream; after a rejected packet the group's later packets are not decoded.

    A group's packets are sorted by their place alone and decoded one at a time; frames are handed on in batches of
    about FRAME_BYTES, so a task holds an epoch's packets and a few frames, never all of its frames.
    """
    schema = arrow_schema(FRAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        decoder, out, held = video.Decoder(), [], 0
        order = np.argsort(t.column("seq").to_numpy(), kind="stable").tolist()
        for place, i in enumerate(order):
            if place % video.TOGETHER == 0:
                inflate = video.inflated([t.column("payload")[j].as_py() for j in order[place : place + video.TOGETHER]])
            r = {c: t.column(c)[i].as_py() for c in ("file_id", "epoch_id", "stream_id", "pts", "payload", "param0", "param1")}
            k = r["file_id"], r["epoch_id"], r["stream_id"], r["pts"]
            try:
                head, frame = decoder.decode(r["payload"], inflate)
                if (head.width, head.height) != (r["param0"], r["param1"]):
                    raise Rejected("BadStream")
            except Rejected as e:
                out.append((*k, None, None, None, None, None, None, e.code))
                break
            out.append((*k, u64(head.frame_id), head.width, head.height, *(p.tobytes() for p in frame.planes), None))
            held += head.width * head.height * 3 // 2
            if held >= FRAME_BYTES:
                yield table(out, schema)
                out, held = [], 0
        yield table(out, schema)

    group = ["file_id", "epoch_id", "stream_id"]
    return spread(routed.where("kind = 'video_frame' AND error_code IS NULL"), *group).groupBy(*group).applyInArrow(run, FRAMES)


_ENVELOPES = "file_id string, epoch_id long, stream_id int, seq long, pts decimal(20,0), param0 long, param1 long, plane int, payload binary, broken string, rank int"
_PLANES = "file_id string, epoch_id long, stream_id int, seq long, pts decimal(20,0), frame_id decimal(20,0), width int, height int, plane int, samples binary, error_code string, rank int"


def decode_video_by_plane(routed: DataFrame) -> DataFrame:
    """``decode_video`` with three tasks for each epoch and stream: payloads are cut into their planes, each of which has its own references.

    A plane stops at its own first rejection. The frame at which the first plane stopped is the group's rejected one, with the error that decoding
    it whole gives; frames before it are joined from their planes, later ones are left out.
    """
    cut, done = arrow_schema(_ENVELOPES), arrow_schema(_PLANES)

    def split(r: dict) -> Iterator[tuple]:
        b = r["payload"]
        parts, broken, rank = [b""] * 3, None, None
        try:
            rank = video.HEADER
            at = video.read_header(b).body
            rank, head = video.ENVELOPE, b[:at]
            parts = [head + raw for raw in video.plane_bytes(b, at)]
        except Rejected as e:
            broken, parts = e.code, [b[: at if rank else len(b)]] * 3
        for plane, part in enumerate(parts):
            yield r["file_id"], r["epoch_id"], r["stream_id"], r["seq"], r["pts"], r["param0"], r["param1"], plane, part, broken, rank if broken else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        plane = t.column("plane")[0].as_py()
        decoder, out, held = video.PlaneDecoder(plane), [], 0
        order = np.argsort(t.column("seq").to_numpy(), kind="stable").tolist()
        for place, i in enumerate(order):
            if place % video.TOGETHER == 0:
                inflate = video.inflated([t.column("payload")[j].as_py() for j in order[place : place + video.TOGETHER]], 1)
            r = {c: t.column(c)[i].as_py() for c in t.column_names}
            k = r["file_id"], r["epoch_id"], r["stream_id"], r["seq"], r["pts"]
            try:
                if r["rank"] == video.HEADER:
                    raise Rejected(r["broken"], video.HEADER)
                head = video.read_header(r["payload"])
                if r["broken"]:
                    decoder.references(head)
                    raise Rejected(r["broken"], video.ENVELOPE)
                samples = decoder.decode(head, video.one_envelope(r["payload"], head.body), (r["param0"], r["param1"]), inflate)
            except Rejected as e:
                out.append((*k, None, None, None, plane, None, e.code, e.detail))
                break
            out.append((*k, u64(head.frame_id), head.width, head.height, plane, samples.tobytes(), None, None))
            held += samples.size
            if held >= FRAME_BYTES:
                yield table(out, done)
                out, held = [], 0
        yield table(out, done)

    packets = routed.where("kind = 'video_frame' AND error_code IS NULL")
    parts = _rows(packets.select("file_id", "epoch_id", "stream_id", "seq", "pts", "param0", "param1", "payload"), _ENVELOPES, split)
    group = ["file_id", "epoch_id", "stream_id"]
    planes = spread(parts, *group, "plane").groupBy(*group, "plane").applyInArrow(run, _PLANES)
    of = lambda k: F.max(F.when(F.col("plane") == k, F.col("samples")))
    frames = planes.groupBy(*group, "seq").agg(
        F.first("pts").alias("pts"), F.max("frame_id").alias("frame_id"), F.max("width").alias("width"), F.max("height").alias("height"),
        of(0).alias("y"), of(1).alias("u"), of(2).alias("v"), F.min(F.when(F.col("error_code").isNotNull(), F.struct("rank", "error_code"))).alias("e"),
    )
    w = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = frames.withColumn("bad", F.count("e").over(w)).where((F.col("bad") == 0) | (F.col("bad") == 1) & F.col("e").isNotNull())
    good = F.col("e").isNull()
    return kept.select(*group, "pts", *(F.when(good, F.col(c)).alias(c) for c in ("frame_id", "width", "height", "y", "u", "v")), F.col("e.error_code").alias("error_code"))


_COUNTS = "file_id string, kind string, stream_id int, n long, rejected long"


def verify(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Decoded packets of each file, kind and stream, and how many were rejected, by full decode.

    One pass over the packets: each goes to the task of its epoch and stream, which decodes what is there in order and hands on counts.
    After a rejected video packet the group's later ones are not decoded.
    """
    schema = arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        counts: dict[tuple[str, int | None], list[int]] = {}
        file_id, kinds, errors, payloads = t.column("file_id")[0].as_py(), t.column("kind").to_pylist(), t.column("error_code").to_pylist(), t.column("payload")
        stream = t.column("stream_id")[0].as_py()

        def count(kind: str, of: int | None, good: bool) -> None:
            counts.setdefault((kind, of), [0, 0])[not good] += 1

        moving = []
        for i, (kind, error) in enumerate(zip(kinds, errors, strict=True)):
            if kind == "epoch_start":
                count("epoch", None, error is None)
            if error is not None:
                count("rejected", stream, False)
            elif kind == "audio_frame":
                try:
                    rate, channels, _ = audio.decode(payloads[i].as_py())
                    count("audio", stream, (rate, channels) == (t.column("param0")[i].as_py(), t.column("param1")[i].as_py()))
                except Rejected:
                    count("audio", stream, False)
            elif kind == "video_frame":
                moving.append(i)
        seq, decoder = t.column("seq").to_pylist(), video.Decoder()
        moving.sort(key=seq.__getitem__)
        for place, i in enumerate(moving):
            if place % video.TOGETHER == 0:
                inflate = video.inflated([payloads[j].as_py() for j in moving[place : place + video.TOGETHER]])
            try:
                head, _ = decoder.decode(payloads[i].as_py(), inflate)
                good = (head.width, head.height) == (t.column("param0")[i].as_py(), t.column("param1")[i].as_py())
            except Rejected:
                good = False
            count("video", stream, good)
            if not good:
                break
        yield table([(file_id, *k, *v) for k, v in counts.items()], schema)

    slim = route(packets, streams).select("file_id", "epoch_id", "stream_id", "seq", "kind", "payload", "param0", "param1", "error_code")
    group = ["file_id", "epoch_id", "stream_id"]
    found = spread(slim, *group).groupBy(*group).applyInArrow(run, _COUNTS)
    return found.groupBy("file_id", "kind", "stream_id").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"))


# --- encoding -------------------------------------------------------------------------------------------------------


def epochs_by_cut(frames: DataFrame, every: int) -> DataFrame:
    """frames (clip_id, frame_index, y, u, v, width, height) with epoch_id: new at every ``every``-th index and at scene cuts.

    The luma of the frame before comes by a window; only the comparison is Python.
    """
    w = Window.partitionBy("clip_id").orderBy("frame_index")

    @F.pandas_udf("boolean")
    def cut(a, b):
        def one(x, y):
            if x is None:
                return False
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            step = max(len(x) // 4096, 1)
            d = np.abs(x[::step].astype(np.int64) - y[::step].astype(np.int64)) if len(x) == len(y) else np.array([255])
            return bool(int(d.sum()) // len(d) > 48)

        return a.combine(b, one)

    start = (F.col("frame_index") % every == 0) | cut("__before", "y")
    f = frames.withColumn("__before", F.lag("y").over(w)).withColumn("__start", start.cast("long"))
    return f.withColumn("epoch_id", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__before", "__start")


ENCODED = "file_id string, epoch_id long, stream_id int, kind string, seq long, pts decimal(20,0), duration long, payload binary, error_code string"


def encode_video(frames: DataFrame, stream_id: int, frame_us: int, q: int = 96, preset: str = "balanced") -> DataFrame:
    """Video packets of clips with epochs; each epoch starts a fresh encoder, so epochs encode in parallel."""
    schema = arrow_schema(ENCODED)

    def run(key, t):
        rows, out = sorted(t.to_pylist(), key=lambda r: r["frame_index"]), []

        def given():
            for r in rows:
                try:
                    yield r["frame_index"], video.Frame.of(r["width"], r["height"], r["y"], r["u"], r["v"])
                except Rejected as e:
                    yield r["frame_index"], e

        for r, payload in zip(rows, video.Encoder(q, preset).encode_all(given()), strict=True):
            i, bad = r["frame_index"], isinstance(payload, Rejected)
            out.append((r["clip_id"], r["epoch_id"], stream_id, "video_frame", i, u64(i * frame_us), frame_us, None if bad else payload, payload.code if bad else None))
        return pa.Table.from_batches([table(out, schema)])

    return spread(frames, "clip_id", "epoch_id").groupBy("clip_id", "epoch_id").applyInArrow(run, ENCODED)


def encode_audio(pcm: DataFrame, stream_id: int, rate: int, channels: int, q: int = 1, mid_side: bool = False) -> DataFrame:
    """Audio packets of (file_id, epoch_id, seq, first_frame, samples): one packet a row."""

    def one(r: dict) -> Iterator[tuple]:
        x = np.array(r["samples"], np.int16)
        n, at = len(x) // channels, r["first_frame"]
        pts, end = at * 1_000_000 // rate, (at + n) * 1_000_000 // rate
        head = (r["file_id"], r["epoch_id"], stream_id, "audio_frame", r["seq"], u64(pts), end - pts)
        try:
            yield *head, audio.encode(x, rate, channels, q, mid_side), None
        except Rejected as e:
            yield *head, None, e.code

    return _rows(pcm.select("file_id", "epoch_id", "seq", "first_frame", "samples"), ENCODED, one)


_RANK = {"video_frame": 0, "audio_frame": 1, "metadata": 2}
_CODE = {v: k for k, v in wire.PACKET_KINDS.items()}
EPOCH_ROWS = "file_id string, epoch_id long, pts decimal(20,0), duration long, data binary, streams string, error_code string"


def described(streams: list[wire.Stream], rows: list[dict]) -> list[wire.Stream]:
    """Descriptors of a file: video without a size takes that of its packets."""
    out = []
    for s in streams:
        first = next((r["payload"] for r in rows if r["kind"] == "video_frame" and r["stream_id"] == s.id and r["payload"]), None)
        if s.kind == 1 and not s.param0 and first:
            head = video.read_header(first)
            s = replace(s, param0=head.width, param1=head.height)
        out.append(s)
    return out


def epoch_bytes(epoch: int, rows: list[dict]) -> tuple[int, int, bytes]:
    """(pts, duration, packets) of an epoch's rows in interleave order."""
    rows.sort(key=lambda r: (int(r["pts"]), _RANK[r["kind"]], r["seq"]))
    first = int(rows[0]["pts"])
    length = max(int(r["pts"]) + r["duration"] for r in rows) - first
    data = wire.encode_packet(wire.epoch_start(epoch, first, length)) + b"".join(wire.encode_packet(wire.Packet(_CODE[r["kind"]], r["stream_id"], int(r["pts"]), r["duration"], r["payload"])) for r in rows)
    return first, length, data


def streams_to_json(streams: list[wire.Stream]) -> str:
    return json.dumps([asdict(s) for s in streams])


def streams_from_json(text: str) -> list[wire.Stream]:
    return [wire.Stream(**x) for x in json.loads(text)]


def mux_epochs(packets: DataFrame, streams: list[wire.Stream]) -> DataFrame:
    """EPOCH_ROWS: the packets of each epoch as bytes, one task an epoch, as the container sink takes them.

    No file is ever one value. A video stream whose size is 0 takes the size of its own clip's packets.
    """
    schema = arrow_schema(EPOCH_ROWS)

    def run(key, t):
        rows = t.to_pylist()
        head = key[0].as_py(), key[1].as_py()
        bad = next((r["error_code"] for r in rows if r["error_code"]), None)
        if bad:
            return pa.Table.from_batches([table([(*head, None, None, None, None, bad)], schema)])
        first, length, data = epoch_bytes(head[1], rows)
        return pa.Table.from_batches([table([(*head, u64(first), length, data, streams_to_json(described(streams, rows)), None)], schema)])

    return packets.groupBy("file_id", "epoch_id").applyInArrow(run, EPOCH_ROWS)


def mux(packets: DataFrame, streams: list[wire.Stream], magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    """Whole files as values (file_id, content, error_code), for files that fit one; the container sink writes others by epoch."""
    out_schema = "file_id string, content binary, error_code string"

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["epoch_id"])
        bad = next((r["error_code"] for r in rows if r["error_code"]), None)
        content = None
        if not bad:
            own = streams_from_json(rows[0]["streams"])
            seen = {s.id: s for r in reversed(rows) for s in streams_from_json(r["streams"]) if s.kind == 2 or s.param0}
            content = wire.build_file([seen.get(s.id, s) for s in own], [(r["epoch_id"], int(r["pts"]), r["duration"], r["data"]) for r in rows], magic=magic)
        return pa.table({"file_id": pa.array([key[0].as_py()]), "content": pa.array([content], pa.binary()), "error_code": pa.array([bad], pa.string())})

    return mux_epochs(packets, streams).groupBy("file_id").applyInArrow(run, out_schema)


def encode_av(frames: DataFrame, pcm: DataFrame, rate: int, channels: int, fps: tuple[int, int], every: int = 48, q: int = 96, preset: str = "balanced", audio_q: int = 1, mid_side: bool = False, cuts: bool = True) -> DataFrame:
    """Container files of clips (frames) and their audio packets (clip_id, seq, first_frame, samples).

    Video epochs begin every ``every`` frames and, with ``cuts``, at scene cuts; audio belongs to the epoch in
    whose time it begins, and what begins after the last video epoch's end is dropped. The interval
    lookup is one ordered pass over both sides of a clip. Every clip keeps its own frame size.
    """
    return mux(*av_packets(frames, pcm, rate, channels, fps, every, q, preset, audio_q, mid_side, cuts))


def av_packets(frames: DataFrame, pcm: DataFrame, rate: int, channels: int, fps: tuple[int, int], every: int = 48, q: int = 96, preset: str = "balanced", audio_q: int = 1, mid_side: bool = False, cuts: bool = True) -> tuple[DataFrame, list[wire.Stream]]:
    """Encoded packets of ``encode_av`` and the descriptors of their streams, for ``mux`` or ``mux_epochs``."""
    tick = fps[1] * 1_000_000 // fps[0]
    f = epochs_by_cut(frames, every) if cuts else frames.withColumn("epoch_id", F.floor(F.col("frame_index") / every))
    marks = f.groupBy("clip_id", "epoch_id").agg(F.min("frame_index").alias("i"), F.max("frame_index").alias("j"))
    begins = marks.select("clip_id", (F.col("i") * tick).alias("at"), "epoch_id", ((F.col("j") + 1) * tick).alias("end"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("first_frame"), F.lit(None).cast("array<short>").alias("samples"))
    sound = pcm.select("clip_id", F.floor(F.col("first_frame") * 1_000_000 / rate).alias("at"), F.lit(None).cast("long").alias("epoch_id"), F.lit(None).cast("long").alias("end"), "seq", "first_frame", "samples")
    w = Window.partitionBy("clip_id").orderBy("at", F.col("seq").isNotNull().cast("int"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = begins.unionByName(sound).withColumn("e", F.last("epoch_id", True).over(w)).withColumn("until", F.last("end", True).over(w))
    placed = placed.where("seq IS NOT NULL AND e IS NOT NULL AND at < until").select(F.col("clip_id").alias("file_id"), F.col("e").alias("epoch_id"), "seq", "first_frame", "samples")
    packets = encode_video(f, 1, tick, q, preset).unionByName(encode_audio(placed, 2, rate, channels, audio_q, mid_side))
    return packets, [wire.Stream(1, 1, 1, wire.TIMESCALE, 0, 0, fps[0] << 16 | fps[1]), wire.Stream(2, 2, 1, wire.TIMESCALE, rate, channels)]


def encode_audio_only(pcm: DataFrame, rate: int, channels: int, epoch_seconds: int = 2, q: int = 1, mid_side: bool = False) -> DataFrame:
    """Container files of audio packets (file_id, seq, first_frame, samples); epochs are whole spans of seconds."""
    p = pcm.withColumn("epoch_id", F.floor(F.col("first_frame") / (rate * epoch_seconds)))
    return mux(encode_audio(p, 2, rate, channels, q, mid_side), [wire.Stream(2, 2, 1, wire.TIMESCALE, rate, channels)])


def only_stream(streams: DataFrame, kind: str) -> DataFrame:
    """The stream of each file that has exactly one of a kind."""
    one = streams.where(F.col("kind") == kind).groupBy("file_id").agg(F.count("*").alias("n"), F.min("stream_id").alias("stream_id")).where("n = 1")
    return one.select("file_id", "stream_id")


def decode_media(packets: DataFrame, streams: DataFrame, by_plane: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, PCM) of the one video and the one audio stream of each file; ``by_plane`` deals an epoch's planes to tasks of their own."""
    r = route(packets, streams)
    return (decode_video_by_plane if by_plane else decode_video)(r).join(only_stream(streams, "video"), ["file_id", "stream_id"]), decode_audio(r).join(only_stream(streams, "audio"), ["file_id", "stream_id"])


def pcm_bytes(pcm: DataFrame) -> DataFrame:
    """Samples of each packet as little-endian 16-bit bytes: the Arrow buffer of the list's values, cut at its offsets."""

    def run(batches):
        for b in batches:
            x = b.column(3)
            at = x.offsets.to_numpy()
            raw = x.values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i2")
            packed = [None if missing else raw[lo:hi].tobytes() for missing, lo, hi in zip(x.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], names=["file_id", "stream_id", "pts", "s16le"])

    slim = pcm.select("file_id", "stream_id", "pts", F.col("samples").cast("array<short>"))
    return slim.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in slim.dtypes[:3]) + ", s16le binary")


def violations(packets: DataFrame, streams: DataFrame, epochs: DataFrame, file_bytes: DataFrame) -> DataFrame:
    """(rule, file_id, detail): broken rules of scanned files, one row each."""
    r = route(packets, streams)
    media = F.col("kind").isin("video_frame", "audio_frame")
    w = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max((F.col("kind") == "epoch_start").cast("int")).over(w)
    rules = [
        r.where("error_code IS NOT NULL").select(F.concat(F.lit("packet:"), "error_code").alias("rule"), "file_id", F.col("byte_offset").alias("detail")),
        r.withColumn("open", opened).where(media & (F.coalesce("open", F.lit(0)) == 0)).select(F.lit("media_before_epoch").alias("rule"), "file_id", F.col("byte_offset").alias("detail")),
        epochs.join(file_bytes, "file_id").where("byte_offset + byte_len > file_bytes").select(F.lit("range_outside_file").alias("rule"), "file_id", F.col("epoch_id").alias("detail")),
        epochs.groupBy("file_id", "epoch_id").count().where("count > 1").select(F.lit("duplicate_epoch").alias("rule"), "file_id", F.col("epoch_id").alias("detail")),
        streams.where("kind = 'video' AND codec = 1 AND (param0 % 2 <> 0 OR param1 % 2 <> 0 OR param0 = 0 OR param1 = 0 OR param0 * param1 > 67108864)").select(F.lit("video_size").alias("rule"), "file_id", F.col("stream_id").cast("long").alias("detail")),
        streams.where("kind = 'audio' AND codec = 1 AND (param0 NOT BETWEEN 8000 AND 384000 OR param1 NOT BETWEEN 1 AND 8)").select(F.lit("audio_format").alias("rule"), "file_id", F.col("stream_id").cast("long").alias("detail")),
        epochs.join(r.where("kind = 'epoch_start'").select("file_id", F.col("byte_offset").cast("decimal(20,0)").alias("byte_offset"), F.col("epoch_id").alias("found")), ["file_id", "byte_offset"], "left").where("found IS NULL OR found <> epoch_id").select(F.lit("offset_without_start").alias("rule"), "file_id", F.col("epoch_id").alias("detail")),
    ]
    out = rules[0]
    for x in rules[1:]:
        out = out.unionByName(x)
    return out


def reindex(files: DataFrame, repair: bool = False, magic: bytes = wire.FILE_MAGIC) -> DataFrame:
    """Files with a rebuilt index (content, epochs, dropped packets), or an error_code."""

    def one(r: dict) -> Iterator[tuple]:
        try:
            yield r["file_id"], *wire.regroup(r["content"], repair, magic), None
        except Rejected as e:
            yield r["file_id"], None, None, None, e.code

    return _rows(files.select("file_id", "content"), "file_id string, content binary, epochs long, dropped long, error_code string", one)
