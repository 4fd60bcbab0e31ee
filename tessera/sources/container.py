"""Data source ``tessera_container``: tables files, streams, epochs, index, packets, packets_meta of container files, and a sink of epochs.

Planning lists the files and opens none. Packets are read in splits of about ``split_bytes`` (fewer where there would be less than
``min_splits`` of them): a large file is cut at byte offsets, and a task takes the epochs of the file's own index that begin in its cut, reading
adjacent ones together; small files share a split. Options: ``path`` (file, folder or glob of one), ``table``, ``magic`` (another
brand than our own), ``epochs`` (comma list), ``from_pts`` and ``to_pts`` (microseconds: a file is read from the last epoch that
begins at or before the one, else its first, up to the last that begins before the other). Filters on epoch_id and upper bounds of pts
prune epochs as well (``load`` turns that on). With ``index``, a Parquet table that ``save_index`` has written in executor tasks, a pruned
read plans from that table's rows that pass, packed into splits by their bytes, so files and epochs that are not wanted cost nothing.

As a stream, table fragments: the bytes of files that appear below the path, in pieces of ``fragment_bytes`` (many to a split), for the parsers of
``tessera.streaming``. Its offset is the bytes read of each file; of a file that still grows whole pieces are read, and the last one when the
length that its own index gives is there. The streaming sink gives each batch's epochs of a file a container of its own, named by file and batch, so a
batch that runs again replaces its own files and no others.

The sink takes rows of ``media.EPOCH_ROWS``, those of a file side by side in order (``save`` deals them so). Epochs are
appended to a hidden file as they come, then copied behind the index in pieces: no file is ever held as one value.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, In, InputPartition, LessThan, LessThanOrEqual

from tessera.operators import media, wire
from tessera.operators.errors import Rejected

from .files import Written, file_system, hidden, listed, publish, withdraw

#: Bytes of a split and at least, files of a split whose indexes alone are read, and bytes that are read or copied at once.
SPLIT, LEAST_SPLIT, INDEXES, COPY, FRAGMENT = 64 << 20, 64 << 10, 64, 8 << 20, 1 << 20
FILES = "file_id string, bytes long, flags long, stream_count int, front_len long, error_code string"
#: Offsets, lengths and times beyond 63 bits are the largest long here: they lie outside every file either way.
INDEX = "file string, file_bytes long, place long, epoch_id long, pts long, byte_offset long, byte_len long, error_code string"
FRAGMENTS = "file_id string, generation long, part long, data binary, last boolean"
SCHEMAS = {"fragments": FRAGMENTS, "files": FILES, "streams": media.STREAMS, "epochs": media.EPOCHS, "index": INDEX, "packets": media.PACKETS, "packets_meta": media.PACKETS.replace("payload binary", "payload_len long")}


def read_prefix(fs, name: str, magic: bytes = wire.FILE_MAGIC) -> wire.Prefix:
    """Reads header and front index and no more."""
    with fs.open_input_file(name) as f:
        head = f.read(wire.HEADER_LEN)
        _, _, front = wire.decode_header(head, magic)
        return wire.parse_prefix(head + f.read(front), magic)


def wanted(epochs: list[wire.Epoch], only: set[int] | None, since: int | None, until: int | None) -> list[tuple[int, wire.Epoch]]:
    """Epochs of a file, with their place, that a read needs."""
    first = 0
    if since is not None:
        before = [k for k, e in enumerate(epochs) if e.pts <= since]
        first = max(before, key=lambda k: (epochs[k].pts, k), default=0)
    return [(k, e) for k, e in enumerate(epochs) if k >= first and (until is None or e.pts < until) and (only is None or e.id in only)]


def long(v: int) -> int:
    return min(v, (1 << 63) - 1)


@dataclass
class Piece:
    """Part of a file: the epochs that begin in [lo, hi), or the given rows (epoch, offset, length, place) of a saved index."""

    name: str
    size: int
    lo: int = 0
    hi: int = 1 << 63
    rows: list[tuple[int, int, int, int]] | None = None
    error: str | None = None


@dataclass
class Split(InputPartition):
    pieces: list[Piece]


def split_size(total: int, split: int, least: int) -> int:
    """Bytes of a split, so that there are as many as asked for."""
    return min(split, max(LEAST_SPLIT, -(-total // max(least, 1))))


def cut(files: list[tuple[str, int]], split: int) -> list[Split]:
    """Files of (name, bytes) in splits of about as many bytes: large ones cut, small ones together."""
    out, held, room = [], [], split
    for name, size in files:
        if size > split:
            n = -(-size // split)
            out += [Split([Piece(name, size, size * k // n, size * (k + 1) // n)]) for k in range(n)]
            continue
        if held and size > room:
            out.append(Split(held))
            held, room = [], split
        held.append(Piece(name, size))
        room -= max(size, split // INDEXES)  # opening a file has its price
    return out + [Split(held)] * bool(held)


def pack(index: pa.Table, split: int) -> list[Split]:
    """Rows of a saved index in splits of about as many bytes; epochs of a file that follow each other stay together."""
    index = index.sort_by([("file", "ascending"), ("place", "ascending")])
    out, room = [], 0
    for r in index.to_pylist():
        size = 0 if r["byte_len"] is None or r["byte_offset"] + r["byte_len"] > r["file_bytes"] else r["byte_len"]
        if not out or size > room:
            out.append(Split([]))
            room = split
        room -= max(size, 1)
        pieces = out[-1].pieces
        if not pieces or pieces[-1].name != r["file"]:
            pieces.append(Piece(r["file"], r["file_bytes"], rows=[], error=r["error_code"]))
        if r["error_code"] is None:
            pieces[-1].rows.append((r["epoch_id"], r["byte_offset"], r["byte_len"], r["place"]))
    return out


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        pts = lambda key: int(options[key]) if key in options else None
        self.path, self.table, self.magic = options["path"], options.get("table", "packets"), wire.file_magic(options.get("magic"))
        self.epochs = {int(x) for x in options["epochs"].split(",")} if options.get("epochs") else None
        self.since, self.until = pts("from_pts"), pts("to_pts")
        self.split, self.least, self.index = int(options.get("split_bytes", SPLIT)), int(options.get("min_splits", 1)), options.get("index")

    def _size(self, total: int) -> int:
        return split_size(total, self.split, self.least)

    def _indexed(self) -> list[Split]:
        """Splits of the rows of the saved index that the read needs; only these rows come to the driver."""
        from pyarrow import dataset

        fs, root = file_system(self.index)
        table, field = dataset.dataset(root, filesystem=fs, format="parquet"), dataset.field
        keep = dataset.scalar(True)
        if self.epochs is not None:
            keep &= field("epoch_id").isin(pa.array(sorted(self.epochs), pa.int64()))
        if self.until is not None:
            keep &= field("pts") < self.until
        rows = table.to_table(filter=keep | field("epoch_id").is_null())  # a rejected file is a row without an epoch
        if self.since is not None:  # the last epoch that begins at or before it, by file
            before = table.to_table(columns=["file", "pts", "place"], filter=field("pts") <= self.since).sort_by([("pts", "ascending"), ("place", "ascending")])
            first = dict(zip(before.column("file").to_pylist(), before.column("place").to_pylist(), strict=True))
            late = [p is None or p >= first.get(f, 0) for f, p in zip(rows.column("file").to_pylist(), rows.column("place").to_pylist(), strict=True)]
            rows = rows.filter(pa.array(late, pa.bool_()))
        return pack(rows, self._size(sum(x or 0 for x in rows.column("byte_len").to_pylist())))

    def partitions(self) -> list[InputPartition]:
        if self.table.startswith("packets") and self.index and (self.epochs, self.since, self.until) != (None, None, None):
            return self._indexed()
        _, files = listed(self.path)
        if not self.table.startswith("packets"):
            n = max(1, min(INDEXES, -(-len(files) // max(self.least, 1))))
            return [Split([Piece(*f) for f in files[i : i + n]]) for i in range(0, len(files), n)]
        return cut(files, self._size(sum(size for _, size in files)))

    def _rows(self, fs, piece: Piece) -> Iterator[tuple]:
        """Rows of a table of indexes, for one file."""
        file_id = posixpath.basename(piece.name)
        try:
            prefix = read_prefix(fs, piece.name, self.magic)
        except Rejected as e:
            if self.table == "files":
                yield file_id, piece.size, None, None, None, e.code
            elif self.table == "index":
                yield piece.name, piece.size, None, None, None, None, None, e.code
            return
        if self.table == "files":
            yield file_id, piece.size, prefix.flags, len(prefix.streams), prefix.length - wire.HEADER_LEN, None
        elif self.table == "streams":
            yield from media.stream_rows(file_id, prefix)
        elif self.table == "index":
            for k, e in enumerate(prefix.epochs):
                yield piece.name, piece.size, k, e.id, long(e.pts), long(e.offset), long(e.length), None
        else:
            yield from media.epoch_rows(file_id, prefix)

    def _packets(self, fs, piece: Piece) -> Iterator[tuple]:
        file_id, rows, error = posixpath.basename(piece.name), piece.rows, piece.error
        if rows is None:
            try:
                prefix = read_prefix(fs, piece.name, self.magic)
            except Rejected as e:
                rows, error = [], e.code if piece.lo == 0 else None
            else:
                inside = lambda e: piece.lo <= min(e.offset, piece.size - 1) < piece.hi
                rows = [(e.id, long(e.offset), long(e.length), k) for k, e in wanted(prefix.epochs, self.epochs, self.since, self.until) if inside(e)]
        if error:
            yield file_id, 0, 0, None, None, None, None, None, None, error
        if not rows:
            return
        with fs.open_input_file(piece.name) as f:
            for group in adjacent(rows, piece.size):
                start = group[0][1]
                if start + group[0][2] > piece.size:
                    yield file_id, group[0][3] << 32, start, group[0][0], None, None, None, None, None, "BadFront"
                    continue
                f.seek(start)
                data = f.read(group[-1][1] + group[-1][2] - start)
                for epoch, offset, length, place in group:
                    own = data[offset - start : offset - start + length] if len(group) > 1 else data
                    for row in media.scan_rows(file_id, own, 0, length, epoch, place << 32):
                        yield *row[:2], row[2] + offset, *row[3:]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        schema, meta, packets = media.arrow_schema(SCHEMAS[self.table]), self.table == "packets_meta", self.table.startswith("packets")
        out, held = [], 0
        for piece in part.pieces:
            for row in self._packets(fs, piece) if packets else self._rows(fs, piece):
                if packets:
                    size = 0 if row[8] is None else len(row[8])
                    if meta:
                        row = (*row[:8], None if row[8] is None else size, row[9])
                    held += 0 if meta else size
                out.append(row)
                if len(out) >= 2_000 or held >= COPY:
                    yield media.table(out, schema)
                    out, held = [], 0
        yield media.table(out, schema)


def adjacent(rows: list[tuple[int, int, int, int]], size: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Epochs that lie end to end, in groups of up to COPY bytes; one that reaches beyond the file is alone."""
    group: list = []
    for r in rows:
        if group and (r[1] != group[-1][1] + group[-1][2] or r[1] + r[2] - group[0][1] > COPY or r[1] + r[2] > size):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


class PushdownReader(ContainerReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("epoch_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.epochs = ids if self.epochs is None else self.epochs & ids
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("pts",):  # an epoch's packets do not begin before it
                end = int(f.value) + 1
                self.until = end if self.until is None else min(self.until, end)
            yield f  # epochs are pruned; Spark still checks the rows


class ContainerWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.magic, self.overwrite = options["path"], wire.file_magic(options.get("magic")), overwrite

    def write(self, iterator) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        done, name, body, out = Written(), None, None, None
        index: list[tuple[int, int, int, int]] = []
        streams: dict[int, wire.Stream] = {}

        def finish():
            out.close()
            temp = hidden(base)
            with fs.open_output_stream(temp) as whole, fs.open_input_stream(body) as packets:
                whole.write(wire.index_of(list(streams.values()), index, self.magic))
                while piece := packets.read(COPY):
                    whole.write(piece)
            fs.delete_file(body)
            done.files.append((temp, f"{base}/{name}.bin"))

        for r in iterator:
            if r.error_code:
                raise ValueError(f"{r.file_id}, epoch {r.epoch_id}: {r.error_code}")
            if r.file_id != name:
                if name is not None:
                    finish()
                if any(f == f"{base}/{r.file_id}.bin" for _, f in done.files):
                    raise ValueError(f"the epochs of {r.file_id} are not side by side")
                name, index, streams, body = r.file_id, [], {}, hidden(base)
                out = fs.open_output_stream(body)
            for s in media.streams_from_json(r.streams):
                if s.id not in streams or s.kind == 1 and not streams[s.id].param0:
                    streams[s.id] = s
            wire.check_epoch(r.epoch_id, bytes(r.data))
            index.append((r.epoch_id, int(r.pts), r.duration, len(r.data)))
            out.write(bytes(r.data))
        if name is not None:
            finish()
        return done

    def commit(self, messages) -> None:
        if self.overwrite:
            fs, files = listed(self.path)
            for old, _ in files:
                fs.delete_file(old)
        publish(self.path, messages)

    def abort(self, messages) -> None:
        withdraw(self.path, messages)


@dataclass
class Bytes:
    """Whole pieces of a file, side by side; with ``last`` the file ends with them."""

    name: str
    lo: int
    hi: int
    last: bool


@dataclass
class Fragments(InputPartition):
    runs: list[Bytes]


class FragmentReader(DataSourceStreamReader):
    """Offsets are {file: bytes read}; a file is read once, however it grew."""

    def __init__(self, options: dict):
        self.path, self.magic, self.size = options["path"], wire.file_magic(options.get("magic")), int(options.get("fragment_bytes", FRAGMENT))
        self.split, self.least = int(options.get("split_bytes", SPLIT)), int(options.get("min_splits", 1))
        self.lengths: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _length(self, fs, name: str, size: int) -> int:
        """How long a file is to be by its own index; what is there, where that cannot be read."""
        if name not in self.lengths:
            try:
                self.lengths[name] = max([(p := read_prefix(fs, name, self.magic)).length, *(e.offset + e.length for e in p.epochs)])
            except Rejected as e:
                if e.code == "UnexpectedEof":
                    return size + 1  # the index itself is still to come
                self.lengths[name] = size
        return self.lengths[name]

    def latestOffset(self) -> dict:
        fs, files = listed(self.path)
        return {name: size if size >= self._length(fs, name, size) else size // self.size * self.size for name, size in files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task takes the pieces of as many bytes as a split of the reader's, however small they are; small files share one."""
        fs, _ = file_system(self.path)
        grown = [(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]
        split = split_size(sum(to - lo for _, lo, to in grown), self.split, self.least)
        step, out, room = max(split // self.size, 1) * self.size, [], 0
        for name, first, to in grown:
            done = to >= self._length(fs, name, to)
            for lo in range(first, to, step):
                hi = min(lo + step, to)
                if not out or hi - lo > room:
                    out.append(Fragments([]))
                    room = split
                out[-1].runs.append(Bytes(name, lo, hi, done and hi == to))
                room -= max(hi - lo, split // INDEXES)  # opening a file has its price
        return out

    def read(self, part: Fragments) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for r in part.runs:
            with fs.open_input_file(r.name) as f:
                f.seek(r.lo)
                for lo in range(r.lo, r.hi, self.size):
                    hi = min(lo + self.size, r.hi)
                    yield posixpath.basename(r.name), 0, lo // self.size, f.read(hi - lo), r.last and hi == r.hi


class SegmentWriter(DataSourceStreamWriter):
    """Epochs of a micro-batch: hidden files in the tasks, and on commit a container for each file and batch."""

    def __init__(self, options: dict):
        self.path, self.writer = options["path"], ContainerWriter(options, False)

    def write(self, iterator) -> Written:
        return self.writer.write(iterator)

    def _named(self, messages, batch: int) -> list[Written]:
        return [Written([(temp, f"{name.removesuffix('.bin')}.{batch:08d}.bin") for temp, name in m.files]) for m in messages if m]

    def commit(self, messages, batchId: int) -> None:
        publish(self.path, self._named(messages, batchId))

    def abort(self, messages, batchId: int) -> None:
        withdraw(self.path, [m for m in messages if m])


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_container"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "packets")]

    def reader(self, schema) -> DataSourceReader:
        return (PushdownReader if self.options.get("pushdown", "false") == "true" else ContainerReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ContainerWriter(dict(self.options), overwrite)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FragmentReader(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return SegmentWriter(dict(self.options))


#: Spark's setting without which a reader that takes filters is refused.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def load(spark, path: str, table: str = "packets", **options):
    """A table of the containers below a path; filters on epoch_id and pts prune what is read, unless ``pushdown`` is "false"."""
    spark.dataSource.register(ContainerSource)
    defaults = {"pushdown": "true", "min_splits": str(spark.sparkContext.defaultParallelism)}
    options = defaults | options
    if options["pushdown"] == "true":
        spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("tessera_container").option("table", table).options(**options).load(path)


def stream(spark, path: str, **options) -> DataFrame:
    """The bytes of the containers below a path as a stream of fragments."""
    spark.dataSource.register(ContainerSource)
    options = {"min_splits": str(spark.sparkContext.defaultParallelism)} | options
    return spark.readStream.format("tessera_container").option("table", "fragments").options(**options).load(path)


def sink(epochs: DataFrame, path: str, checkpoint: str, **options):
    """A stream writer of EPOCH_ROWS to containers below a path, one for each file and batch; ``start`` it."""
    epochs.sparkSession.dataSource.register(ContainerSource)
    return epochs.writeStream.format("tessera_container").option("path", path).option("checkpointLocation", checkpoint).options(**options)


def save_index(spark, path: str, to: str, **options) -> None:
    """The epochs of all containers below a path as a Parquet table (INDEX) for the option ``index``: read in executor tasks, one row an epoch."""
    load(spark, path, "index", **options).sortWithinPartitions("file", "place").write.mode("overwrite").parquet(to)


def save(epochs: DataFrame, path: str, mode: str = "append", order: str = "epoch_id", **options) -> None:
    """Write EPOCH_ROWS as one container file for each file_id, its epochs by a column; a name that exists is replaced."""
    epochs.sparkSession.dataSource.register(ContainerSource)
    rows = epochs.repartition("file_id").sortWithinPartitions("file_id", order)
    rows.write.format("tessera_container").option("path", path).options(**options).mode(mode).save()


def play(spark, path: str, at: int, **options) -> tuple[DataFrame, DataFrame]:
    """(frames, PCM) from the epoch in which a time lies (the last that begins at or before it, else the first) to the end of each file."""
    return media.decode_media(load(spark, path, from_pts=str(at), **options), load(spark, path, "streams", **options))
