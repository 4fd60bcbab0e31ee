"""Reindexing and repair of container files of any size, in parallel within a file.

A sequential repair reads packet after packet and, at one that it must reject, goes on at the next packet magic. Where it
goes on therefore depends on all that came before. Here a file is cut into byte ranges, and each range is read
by itself from every packet magic in it: whether a packet begins there, and where a chain that comes to that place leaves the range. Chains meet
soon, so a range has few ways out; an ordered walk over the ranges of a file, a few rows each, gives the place at which the sequential reader
enters each one. From there every range keeps its packets by itself. What is left is the sequential reader's result, byte for byte.
"""

from __future__ import annotations

import posixpath
import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.checksum import crc32c
from tessera.operators import media, wire
from tessera.operators.errors import Rejected

from . import container
from .files import file_system, listed

#: Bytes of a range.
RANGE = 64 << 20
_FILES = "file string, size long, start long, streams string, durations string, error string"
_FOUND = "file string, r long, pos long, length long, error string, kind int, epoch long, pts decimal(20,0), duration long, out long, hunts boolean"
_KEPT = "file string, r long, pos long, length long, start boolean, local long, epoch long, pts decimal(20,0), duration long, dropped long, error string"


class Held:
    """Bytes [lo, hi) of a file at hand; others are read as they are asked for."""

    def __init__(self, f, lo: int, hi: int):
        self.f, self.lo = f, lo
        f.seek(lo)
        self.data = f.read(hi - lo)

    def take(self, at: int, n: int) -> bytes:
        if self.lo <= at and at + n <= self.lo + len(self.data):
            return self.data[at - self.lo : at - self.lo + n]
        self.f.seek(at)
        return self.f.read(n)


def packet_at(w: Held, at: int, size: int, streams: dict[int, wire.Stream]) -> wire.Packet:
    """The packet at a place of a file of ``size`` bytes, or its rejection; a payload is only read behind a sound header."""
    head = w.take(at, min(wire.PACKET_HEAD, size - at))
    if len(head) == wire.PACKET_HEAD and struct.unpack_from("<I", head, 24)[0] == crc32c(head[:24]):
        n = struct.unpack_from("<I", head, 20)[0]
        if n <= wire.MAX_PACKET:
            head = w.take(at, min(wire.PACKET_HEAD + n + wire.PACKET_TAIL, size - at))
    p = wire.decode_packet(head)
    wire.route(p, streams)
    return p


def found_in(w: Held, lo: int, hi: int, size: int, streams: dict[int, wire.Stream]) -> list[tuple]:
    """(pos, length or 0, error, kind, epoch, pts, duration, out, hunts) of every packet magic in [lo, hi).

    A chain that comes to pos leaves the range at ``out``, either with a packet due there or hunting for the next magic.
    """
    rows, at = [], w.data.find(wire.PACKET_MAGIC, 0, hi - lo + 3)
    while at >= 0:
        pos = lo + at
        try:
            p = packet_at(w, pos, size, streams)
            epoch = struct.unpack("<I", p.payload)[0] if p.kind == 1 and len(p.payload) == 4 else None
            rows.append([pos, p.size, None, p.kind, epoch, p.pts, p.duration])
        except Rejected as e:
            rows.append([pos, 0, e.code, None, None, None, None])
        at = w.data.find(wire.PACKET_MAGIC, at + 1, hi - lo + 3)
    places, lost = [r[0] for r in rows], (hi, True)
    ways: list[tuple[int, bool]] = [lost] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        after = places[k] + rows[k][1]
        if not rows[k][1]:
            ways[k] = ways[k + 1]
        elif after >= hi:
            ways[k] = (after, False)
        else:
            ways[k] = ways[bisect_left(places, after)]
    return [(*r, *ways[k]) for k, r in enumerate(rows)]


def entries(size: int, start: int, span: int, turns: dict[int, list[tuple[int, int, bool]]]) -> Iterator[tuple[int, int, bool]]:
    """(range, place, hunting) of every range that the sequential reader enters; ``turns`` has (pos, out, hunts) by range, where the way out changes."""
    at, hunts = start, False
    while at < size:
        r = at // span
        yield r, at, hunts
        ways = turns.get(r, [])
        end = min((r + 1) * span, size)
        k = next((k for k, (pos, last, *_) in enumerate(ways) if last >= at), None)
        at, hunts = (end, True) if k is None else ways[k][2:]


def kept_in(rows: list[tuple], at: int, hunts: bool, hi: int, size: int) -> Iterator[tuple]:
    """What the reader keeps of a range: rows (pos, length, start, local, epoch, pts, duration, dropped, error); a dropped one has no length.

    ``local`` counts the epoch starts of the range up to the packet.
    """
    places, local = [r[0] for r in rows], 0

    def astray(at: int) -> tuple:
        return at, 0, False, local, None, None, None, 1, "UnexpectedEof" if size - at < wire.PACKET_HEAD else "BadMagic"

    k = bisect_left(places, at)
    if not hunts and at < size and (k == len(rows) or places[k] != at):
        yield astray(at)
    while k < len(rows):
        pos, length, error, kind, epoch, pts, duration = rows[k][:7]
        if error:
            yield pos, 0, False, local, None, None, None, 1, error
            k += 1
            continue
        if kind == 1 and epoch is None:
            yield pos, 0, False, local, None, None, None, 1, "BadEpoch"
        else:
            local += kind == 1
            yield pos, length, kind == 1, local, epoch, pts, duration, 0, None
        after = pos + length
        if after >= hi:
            return
        k = bisect_left(places, after)
        if k == len(rows) or places[k] != after:
            yield astray(after)


def _file_rows(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """A row for each file below a path: size, where packets begin, its streams, the durations that its index gives, or why its prefix is rejected."""
    import json

    _, names = listed(path)
    schema = media.arrow_schema(_FILES)

    def run(batches):
        fs, _ = file_system(path)
        for b in batches:
            out = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    p = container.read_prefix(fs, name, magic)
                    out.append((name, size, p.length, media.streams_to_json(p.streams), json.dumps({str(e.id): e.duration for e in p.epochs if e.duration}), None))
                except Rejected as e:
                    out.append((name, size, None, None, None, e.code))
            yield media.table(out, schema)

    names = spark.createDataFrame(names, "file string, size long")
    return names.repartition(max(1, min(spark.sparkContext.defaultParallelism, names.count()))).mapInArrow(run, _FILES)


class Resync:
    """A repaired reading of the container files below a path; intermediates go to ``work``, a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, work: str, magic: bytes = wire.FILE_MAGIC, span: int = RANGE):
        self.spark, self.path, self.work, self.span, self.magic = spark, path, work, span, magic
        self.files = self._saved(_file_rows(spark, path, magic), "files")
        self.found = self._saved(self._find(), "found")
        self.kept = self._saved(self._keep(), "kept")
        self.packets = self._numbered()

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.work}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.work}/{name}")

    def _find(self) -> DataFrame:
        span, path, schema = self.span, self.path, media.arrow_schema(_FOUND.replace("boolean", "int"))
        schema = schema.set(len(schema) - 1, pa.field("hunts", pa.bool_()))

        def run(batches):
            fs, _ = file_system(path)
            for b in batches:
                for x in b.to_pylist():
                    streams = {s.id: s for s in media.streams_from_json(x["streams"])}
                    lo, hi = max(x["r"] * span, x["start"]), min((x["r"] + 1) * span, x["size"])
                    with fs.open_input_file(x["file"]) as f:
                        rows = found_in(Held(f, lo, min(hi + 3, x["size"])), lo, hi, x["size"], streams)
                    for k in range(0, len(rows), 10_000):
                        yield media.table([(x["file"], x["r"], *r[:5], media.u64(r[5]), *r[6:]) for r in rows[k : k + 10_000]], schema)

        first, last = F.floor(F.col("start") / span), F.floor((F.col("size") - 1) / span)
        ranges = self.files.where("error IS NULL AND start < size").select("file", "size", "start", "streams", F.explode(F.sequence(first, last)).alias("r"))
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return ranges.repartition(tasks, "file", "r").mapInArrow(run, _FOUND)

    def _entries(self) -> DataFrame:
        """(file, r, at, hunting): where the sequential reader enters each range."""
        span = self.span
        w = Window.partitionBy("file", "r").orderBy("pos")
        way = F.struct("out", "hunts")
        new = F.coalesce(F.lag(way).over(w) != way, F.lit(True)).cast("long")
        turns = self.found.withColumn("turn", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        turns = turns.groupBy("file", "r", "turn").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.first("out").alias("out"), F.first("hunts").alias("hunts"))

        def walk(left: pa.Table, right: pa.Table) -> pa.Table:
            x, by = left.to_pylist()[0], {}
            for t in sorted(right.to_pylist(), key=lambda t: (t["r"], t["pos"])):
                by.setdefault(t["r"], []).append((t["pos"], t["last"], t["out"], t["hunts"]))
            rows = list(entries(x["size"], x["start"], span, by))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.table({"file": pa.array([x["file"]] * len(rows), pa.string()), "size": pa.array([x["size"]] * len(rows), pa.int64()), "r": pa.array(cols[0], pa.int64()), "at": pa.array(cols[1], pa.int64()), "hunting": pa.array(cols[2], pa.bool_())})

        good = self.files.where("error IS NULL").select("file", "size", "start")
        return good.groupBy("file").cogroup(turns.groupBy("file")).applyInArrow(walk, "file string, size long, r long, at long, hunting boolean")

    def _keep(self) -> DataFrame:
        span = self.span
        schema = media.arrow_schema(_KEPT.replace("start boolean", "start int"))
        schema = schema.set(4, pa.field("start", pa.bool_()))

        def keep(key, left, right):
            if not left.num_rows:
                return pa.Table.from_batches([media.table([], schema)])
            x = left.to_pylist()[0]
            cols = ("pos", "length", "error", "kind", "epoch", "pts", "duration")
            rows = sorted(zip(*(right.column(c).to_pylist() for c in cols), strict=True), key=lambda r: r[0])
            out = kept_in(rows, x["at"], x["hunting"], min((x["r"] + 1) * span, x["size"]), x["size"])
            return pa.Table.from_batches([media.table([(x["file"], x["r"], *o) for o in out], schema)])

        return self._entries().groupBy("file", "r").cogroup(self.found.groupBy("file", "r")).applyInArrow(keep, _KEPT)

    def _numbered(self) -> DataFrame:
        """Kept rows with ``ordinal``, the number of epoch starts of the file up to each: sums by range, carried on, and places within a range."""
        before = Window.partitionBy("file").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        sums = self.kept.groupBy("file", "r").agg(F.max("local").alias("n")).select("file", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return self.kept.join(sums, ["file", "r"]).withColumn("ordinal", F.col("base") + F.col("local")).drop("base", "local")

    def outcome(self, repair: bool = True) -> DataFrame:
        """(file_id, epochs, dropped, error_code) of every file: as read on after errors, or strictly."""
        early = (F.col("length") > 0) & (F.col("ordinal") == 0)
        code = F.coalesce("error", F.when(early, F.lit("BadEpoch")))
        all_ = self.packets.groupBy("file").agg(
            F.count_if("start").alias("epochs"),
            F.sum(F.col("dropped") + early.cast("long")).alias("dropped"),
            F.min(F.when(code.isNotNull(), F.struct("pos", code.alias("code")))).alias("first"),
        )
        twice = self.packets.where("start").groupBy("file", "epoch").count().where("count > 1").select("file").distinct().withColumn("twice", F.lit(True))
        j = self.files.join(all_, "file", "left").join(twice, "file", "left")
        error = F.coalesce("error", *([] if repair else ["first.code"]), F.when(F.coalesce("epochs", F.lit(0)) == 0, F.lit("BadEpoch")), F.when(F.col("twice"), F.lit("BadFront")))
        out = j.select("file", F.substring_index("file", "/", -1).alias("file_id"), error.alias("error_code"), "epochs", F.coalesce("dropped", F.lit(0)).alias("dropped"))
        fine = F.col("error_code").isNull()
        return out.select("file", "file_id", F.when(fine, F.col("epochs")).alias("epochs"), F.when(fine, F.col("dropped")).alias("dropped"), "error_code")

    def epochs(self, repair: bool = True) -> DataFrame:
        """EPOCH_ROWS and their ``ordinal`` of the files without an error; an epoch's bytes are read in the task that hands them on."""
        import json

        path, ddl = self.path, media.EPOCH_ROWS + ", ordinal long"
        schema = media.arrow_schema(ddl)
        good = self.outcome(repair).where("error_code IS NULL").select("file").join(self.files.select("file", "streams", "durations"), "file")

        def build(key, t):
            fs, _ = file_system(path)
            rows = sorted(t.to_pylist(), key=lambda r: r["pos"])
            first, data = rows[0], bytearray()
            with fs.open_input_file(first["file"]) as f:
                k = 0
                while k < len(rows):  # packets that lie end to end are read together
                    a = b = rows[k]["pos"]
                    while k < len(rows) and rows[k]["pos"] == b:
                        b += rows[k]["length"]
                        k += 1
                    f.seek(a)
                    data += f.read(b - a)
            duration = first["duration"] or json.loads(first["durations"]).get(str(first["epoch"]), 0)
            name = posixpath.basename(first["file"]).removesuffix(".bin")
            return pa.Table.from_batches([media.table([(name, first["epoch"], first["pts"], duration, bytes(data), first["streams"], None, first["ordinal"])], schema)])

        slim = self.packets.where("length > 0 AND ordinal > 0").join(good, "file")
        return slim.groupBy("file", "ordinal").applyInArrow(build, ddl)

    def save(self, to: str, repair: bool = True, **options) -> None:
        """Files with a new index below another path, written by the container sink epoch by epoch."""
        container.save(self.epochs(repair), to, order="ordinal", **options)
