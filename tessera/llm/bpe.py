"""Byte-level BPE through a sentencepiece model that is serialised here from a rank file.

Every byte is written as one printable code point, every token becomes a piece with score
-rank, and normalisation is the identity; so sentencepiece's highest-score merge is the
lowest-rank merge. Texts are first cut into pre-tokens, each encoded separately.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import binary_text, bounded_batches

#: Entries of each of the two generations of a worker's pre-token cache: rare pre-tokens leave, frequent ones stay; no result depends on it.
CACHE = 300_000


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(no: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(no << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    return _varint(no << 3) + _varint(value)


def byte_map() -> list[str]:
    """A printable code point for each byte: Latin-1's own where it is printable, else from 256 up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE ModelProto; token i has id i and score -i, the unknown piece comes last."""
    to = byte_map()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, "".join(to[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b" unknown ") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, b" unknown ")
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normal))


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class BytePieceTokenizer(dict):
    """encode() and decode(); as a dict it caches the packed ids of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.to = byte_map()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        back = {c: b for b, c in enumerate(self.to)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.find = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode()
            known = self.whole.get(raw)
            ids = [known] if known is not None else self.model.encode("".join([self.to[b] for b in raw]))
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def tokenizer(path: str, pattern: str) -> BytePieceTokenizer:
    """One for each worker process, which serves many tasks."""
    return BytePieceTokenizer(path, pattern)


def encode_frame(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and ``ids`` (binary, little-endian u32); a null text is empty."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep, binary_text(text).alias("ids")).schema

    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            ids = [t.encode(x.decode()) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=b.schema.names)

    return docs.select(*keep, binary_text(text).alias("ids")).mapInArrow(run, schema)


def op7_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, for every row.

    A null or empty text has no tokens. Repeated rows repeat, null ids too. An empty table gives no
    rows. Extra columns are ignored. A very long text, or a long run without a cut, is encoded whole in one task.
    """

    def run(batches):
        t = tokenizer(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py().decode())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(t.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", binary_text("text").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
