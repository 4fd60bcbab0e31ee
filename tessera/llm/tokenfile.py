"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: frames of ids (each with zstandard's own content checksum); a skippable frame
with the document index, itself compressed; a skippable frame with the seek table of the
public zstandard seekable format (sizes and a 32-bit checksum of every frame). A reader
takes the tail of the file, then only the frames that hold the documents it asks for.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import binary_text, reduce_width

#: Fixed values of the zstandard format: skippable frames, the seek table's end.
INDEX_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids after which a frame is closed; a longer document is a frame of its own.
FRAME_IDS = 1 << 15
#: Chunks in each generation of a worker's cache.
CACHE = 700_000
#: Letters with their own code points in both cases, and marks that may follow a word; no apostrophe (contractions) and none of the special tokens' ``<|>``.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(rf"([{LETTERS}]+)([!-&(-/:;=?@\[-`{{}}~]*)")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileWriter:
    """Writes one file; documents come in ascending order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.kind, self.width = out, f"<u{width}", width
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.seek, self.rows, self.open, self.n = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.n and self.n + len(ids) // self.width > FRAME_IDS:
            self.flush()
        self.rows.append((doc_id is not None, doc_id or 0, len(self.seek), self.n, len(ids) // self.width))
        self.open.append(ids)
        self.n += len(ids) // self.width

    def flush(self) -> None:
        import xxhash

        if self.open:
            raw = b"".join(self.open)
            frame = self.pack.compress(raw)
            self.out.write(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.n = [], 0

    def close(self) -> None:
        self.flush()
        rows = np.array(self.rows, np.int64).reshape(-1, 5)
        body = self.pack.compress(struct.pack("<II", self.width, len(rows)) + rows.T.astype("<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body) + 4) + body + struct.pack("<I", len(body)))
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FileReader:
    """The index of one file, and its documents; frames are read and decompressed on demand."""

    def __init__(self, source):
        import zstandard

        self.f, size = source, source.size()
        self.unpack = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * n
        self.seek = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        (body,) = struct.unpack("<I", self._at(table - 12, 4))
        raw = self.unpack.decompress(self._at(table - 12 - body, body))
        self.width, rows = struct.unpack_from("<II", raw)
        self.rows = np.frombuffer(raw, "<i8", offset=8).reshape(5, rows)
        self.last = (-1, b"")

    def _at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.last[0] != k:
            raw = self.unpack.decompress(self._at(int(self.at[k]), int(self.seek[k, 0])))
            if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, raw)
        return self.last[1]

    def documents(self, only: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids), in the file's order."""
        before = 0
        for has, doc, k, at, n in self.rows.T.tolist():
            if only is None or (doc if has else None) in only:
                raw = self.frame(k)[at * self.width : (at + n) * self.width] if n else b""
                yield doc if has else None, before, np.frombuffer(raw, f"<u{self.width}")
            before += n


class WordCacheEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct space-free chunk.

    Sound for tokenizers whose normaliser and pre-tokeniser never join characters across
    ASCII white space and drop it, as the word BPE here does; tests hold whole texts against
    the library itself. Two generations of up to CACHE chunks are kept, so that rare
    ones leave and frequent ones stay; a chunk that has left is asked again.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.width = 2 if max(self.t.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.packs = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)]
        self.end = self.pack([end_id])
        ids = lambda w: self.t.encode(w, add_special_tokens=False).ids
        self.folds = ids("ABCDEFGHIJKLM NOPQRSTUVWXYZ") == ids("abcdefghijklm nopqrstuvwxyz")
        self.letters, self.tails = self._letters(ids), {"": b""}
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _letters(self, ids) -> dict[int, str] | None:
        """Each letter as the model is given it, if a run of them is one pre-token whose ids are the model's own; else None."""
        if self.t.normalizer is None or self.t.pre_tokenizer is None:
            return None
        pieces = lambda x: [p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(x))]
        each = [pieces(c) for c in LETTERS]
        if any(len(p) != 1 for p in each) or pieces(LETTERS) != ["".join(p for p, in each)]:
            return None
        table = {ord(c): p for c, (p,) in zip(LETTERS, each, strict=True)}
        whole = [*ids(LETTERS), *ids("."), *ids("!?")]
        return table if ids(f"{LETTERS} . !?") == ids(f"{LETTERS}.") + ids("!?") == whole and [x.id for x in self.t.model.tokenize(LETTERS.translate(table))] == ids(LETTERS) else None

    def pack(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < 64 else np.array(ids, f"<u{self.width}").tobytes()

    def texts(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Ids of each text and its end, packed. Texts are split and their chunks numbered by Arrow: Python sees every distinct chunk once.

        Chunks of ASCII alone are folded first where the tokenizer folds them anyway. Others go to the library as they are: it
        composes before it folds, and a capital with a mark may have no composed form.
        """
        if not len(texts):
            return []
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        words = pc.ascii_split_whitespace(column.view(pa.string()))  # with empty chunks at white space that begins or ends a text
        places = words.flatten().dictionary_encode()
        distinct = places.dictionary
        if self.folds:  # special tokens are matched before folding
            plain = pc.and_not(pc.string_is_ascii(distinct), pc.match_substring(distinct, "<|"))
            distinct = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        chunks = distinct.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = pa.array(self._found(chunks), pa.large_binary()).take(places.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[np.asarray(words.offsets)].tolist()
        data = found.buffers()[2].to_pybytes()
        return [data[lo:hi] + self.end for lo, hi in itertools.pairwise(ends)]

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk; those that neither generation holds are asked."""
        if len(self.now) > CACHE:
            self.now, self.old = {}, self.now
        out = list(map(self.now.get, chunks))
        missed = [k for k, x in enumerate(out) if x is None]
        again = list(map(self.old.get, map(chunks.__getitem__, missed)))
        asked = [chunks[k] for k, x in zip(missed, again, strict=True) if x is None]
        told = iter(self._asked([w.decode() for w in asked]))
        for k, x in zip(missed, again, strict=True):
            out[k] = self.now[chunks[k]] = next(told) if x is None else x
        return out

    def _asked(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the library. Of letters and marks at most, a run of each is a pre-token, and the letters go to its model straight."""
        out: list = [None] * len(chunks)
        rest, tokenize = [], self.t.model.tokenize
        for k, w in enumerate(chunks):
            plain = PLAIN.fullmatch(w) if self.letters else None
            if plain is None:
                rest.append(k)
                continue
            word, tail = plain.groups()
            if tail not in self.tails:
                if len(self.tails) > CACHE:
                    self.tails = {"": b""}
                self.tails[tail] = self.pack(self.t.encode(tail, add_special_tokens=False).ids)
            out[k] = self.pack([x.id for x in tokenize(word.translate(self.letters))]) + self.tails[tail]
        for k, e in zip(rest, self.t.encode_batch([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = self.pack(e.ids)
        return out


@functools.cache
def encoder(path: str, end_id: int) -> WordCacheEncoder:
    """One for each worker process, which serves many tasks."""
    return WordCacheEncoder(path, end_id)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode every text, end each with ``end_id`` and write files whose names ascend with doc_id.

    Returns the manifest (file, docs, ids, bytes), one row a file. Rows are dealt by range of (doc_id, text hash), so a
    repeated doc_id does not fill one task; ties are ordered by text. Null ids come first, null texts are
    empty. Every attempt writes under a name of its own and then renames: a retried or doubled
    task leaves the same single file.
    """
    order = ["doc_id", "h", "text"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text("text").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = slim.repartitionByRange(reduce_width(docs), "doc_id", "h").sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        fs, root = _fs(out)
        fs.create_dir(root, recursive=True)
        name = f"{root}/ids-{TaskContext.get().partitionId():06d}.tok"
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        enc, docs, ids, w = None, 0, 0, None
        with fs.open_output_stream(temp) as f:
            for b in batches:
                enc = enc or encoder(tokenizer, end_id)
                w = w or FileWriter(f, enc.width)
                for doc, x in zip(b.column(0).to_pylist(), enc.texts(b.column(1)), strict=True):
                    w.add(doc, x)
                    docs, ids = docs + 1, ids + len(x) // enc.width
            if w:
                w.close()
        if not w:
            fs.delete_file(temp)
            return
        size = fs.get_file_info(temp).size
        fs.move(temp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([size], pa.int64())], names=["file", "docs", "ids", "bytes"])

    return dealt.select("doc_id", "text").mapInArrow(run, "file string, docs long, ids long, bytes long")


def read_tokens(spark: SparkSession, manifest: DataFrame, root: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all or the requested documents of the files in a manifest; ids are null unless asked for.

    start counts ids over all files in order of their names; only one number a file goes to the driver.
    """
    files = sorted((r["file"], r["ids"]) for r in manifest.select("file", "ids").collect())
    base, rows = 0, []
    for name, n in files:
        rows.append((name, base))
        base += n
    only = None if doc_ids is None else set(doc_ids)

    def run(batches):
        fs, _ = _fs(root)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(name) as f:
                    got: list = []
                    for doc, before, ids in FileReader(f).documents(only):
                        wide = ids.astype("<u4")
                        got.append((doc, first + before, len(ids), zlib.crc32(wide), wide.tobytes() if with_ids else None))
                        if len(got) == 512:
                            yield _rows(got)
                            got = []
                    if got:
                        yield _rows(got)

    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    listed = spark.createDataFrame(rows, "file string, first long").repartition(len(rows))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(got: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def op10_token_files(docs: DataFrame, tokenizer: str, out: str) -> DataFrame:
    """Write the token files below ``out`` and read them back: a row for every document.

    A null or empty text is the end id alone. Rows without a doc_id come first; rows that share one are ordered by
    text, repeated rows are all written. An empty table writes no files and gives no rows. Extra columns are
    ignored. A very long text is encoded whole in one task and fills a frame of its own.
    """
    manifest = write_tokens(docs, out, tokenizer)
    spark = docs.sparkSession
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return read_tokens(spark, spark.read.schema(manifest.schema).parquet(f"{out}/manifest"), out, with_ids=False).drop("ids")
