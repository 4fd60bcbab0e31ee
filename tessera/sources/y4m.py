"""Y4M files as rows, one a frame, and back: data source ``tessera_y4m``, and clips held as values."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from tessera.operators import y4m
from tessera.operators.errors import Rejected
from tessera.operators.media import _rows
from tessera.operators.video import Frame

from .files import Written, file_system, hidden, listed, publish, withdraw

CLIPS = "clip_id string, frame_index long, width int, height int, fps_n int, fps_d int, meta0 long, y binary, u binary, v binary, error_code string"
#: Bytes of frames that one partition reads (option ``read_bytes``), and the longest header.
READ_BYTES, HEAD = 32 << 20, 4096


def _clip_rows(clip_id: str, content: bytes, first: int = 0) -> Iterator[tuple]:
    try:
        c = y4m.parse(content)
    except Rejected as e:
        yield clip_id, *[None] * 9, e.code
        return
    for i, f in enumerate(c.frames, first):
        yield clip_id, i, c.width, c.height, c.fps_n, c.fps_d, c.meta0, *(p.tobytes() for p in f.planes), None


def frames(files: DataFrame) -> DataFrame:
    """Frames of (file_id, content) rows; a rejected clip is one row with an error_code."""
    return _rows(files.select("file_id", "content"), CLIPS, lambda r: _clip_rows(r["file_id"], r["content"]))


def files(clips: DataFrame) -> DataFrame:
    """(file_id, content): clips that fit a value, their frames in order."""

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["frame_index"])
        a = rows[0]
        clip = y4m.Clip(a["width"], a["height"], a["fps_n"], a["fps_d"], a["meta0"], [Frame.of(r["width"], r["height"], r["y"], r["u"], r["v"]) for r in rows])
        return pa.table({"file_id": pa.array([a["clip_id"]]), "content": pa.array([y4m.emit(clip)], pa.binary())})

    return clips.where("error_code IS NULL").groupBy("clip_id").applyInArrow(run, "file_id string, content binary")


@dataclass
class Frames(InputPartition):
    name: str
    head: bytes
    offset: int
    length: int  # -1: to the end
    first: int


class Y4mReader(DataSourceReader):
    """Planning reads headers only. Frames without parameters have one size, so a partition is a run of them;
    a file whose size is no whole number of such frames is one partition, which finds out why."""

    def __init__(self, path: str, read_bytes: int):
        self.path, self.read_bytes = path, read_bytes

    def partitions(self) -> list[InputPartition]:
        fs, found = listed(self.path)
        out: list[InputPartition] = []
        for name, size in found:
            with fs.open_input_file(name) as f:
                head = f.read(HEAD)
            end = head.find(b"\n") + 1
            try:
                clip = y4m.parse(head[:end])
            except Rejected:
                out.append(Frames(name, b"", 0, -1, 0))
                continue
            one = 6 + clip.width * clip.height * 3 // 2
            n, rest = divmod(size - end, one)
            if rest:
                out.append(Frames(name, b"", 0, -1, 0))
                continue
            step = max(1, self.read_bytes // one)
            out += [Frames(name, head[:end], end + k * one, min(step, n - k) * one, k) for k in range(0, max(n, 1), step)]
        return out

    def read(self, part: Frames) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        clip_id = posixpath.basename(part.name).removesuffix(".y4m")
        with fs.open_input_file(part.name) as f:
            f.seek(part.offset)
            data = part.head + (f.read() if part.length < 0 else f.read(part.length))
        rows = list(_clip_rows(clip_id, data, part.first))
        if part.length >= 0 and any(r[-1] for r in rows):  # frames with parameters that happen to fill the size
            if part.first:
                return
            with fs.open_input_file(part.name) as f:
                rows = _clip_rows(clip_id, f.read())
        yield from rows


class Y4mWriter(DataSourceWriter):
    """Rows of CLIPS, those of a clip side by side in order: each frame is appended as it comes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        done, name, out = Written(), None, None
        for r in iterator:
            if r.clip_id != name:
                if out:
                    out.close()
                temp = hidden(base)
                done.files.append((temp, f"{base}/{r.clip_id}.y4m"))
                name, out = r.clip_id, fs.open_output_stream(temp)
                out.write(y4m.emit(y4m.Clip(r.width, r.height, r.fps_n, r.fps_d, r.meta0)))
            out.write(b"FRAME\n" + bytes(r.y) + bytes(r.u) + bytes(r.v))
        if out:
            out.close()
        return done

    def commit(self, messages) -> None:
        publish(self.path, messages)

    def abort(self, messages) -> None:
        withdraw(self.path, messages)


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_y4m"

    def schema(self) -> str:
        return CLIPS

    def reader(self, schema) -> DataSourceReader:
        return Y4mReader(self.options["path"], int(self.options.get("read_bytes", READ_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Y4mWriter(self.options["path"])


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of the Y4M files below a path, many partitions a file."""
    spark.dataSource.register(Y4mSource)
    return spark.read.format("tessera_y4m").options(**options).load(path)


def save(clips: DataFrame, path: str) -> None:
    """One Y4M file for each clip_id; rejected rows have no frames and are left out."""
    clips.sparkSession.dataSource.register(Y4mSource)
    rows = clips.where("error_code IS NULL").repartition("clip_id").sortWithinPartitions("clip_id", "frame_index")
    rows.write.format("tessera_y4m").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Frames of files that Spark's own reader finds, each read as one value."""
    f = spark.read.format("binaryFile").load(path)
    return frames(f.select(F.element_at(F.split("path", "/"), -1).alias("file_id"), "content"))
