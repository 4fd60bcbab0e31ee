"""Language-model scoring from a log-frequency Bloom filter.

An n-gram seen c times is entered as (n-gram, 1) .. (n-gram, level), level = 1 + floor(log_b c).
A count is read back by probing levels upward until one is absent. Orders are smoothed by
interpolation: P_n(w | h) = L * c(hw) / c(h) + (1 - L) * P_{n-1}(w | h'), down to add-one unigrams.

The filter is built in segments, each sized by what it holds at BITS an entry, so that the error
rate is the same for every corpus. A filter of up to MAX_BYTES is broadcast and probed in the
scoring pass itself. A larger one stays where it was built: texts are kept in chunks, the distinct
n-grams of each chunk travel to their segments in one shuffle, are probed there, and their levels
come back to the chunk. Both ways give the same levels, at a cost in proportion to the texts.
Exact counts for the base score never pass through the filter: the most frequent words
(a bounded table) are broadcast, all others meet their counts in a shuffle by segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .segments import FLUSH, blobs, cut, dealt, give_back, joined, segment_bits, sum_by_key
from .store import Workspace, binary_text, reduce_width

ORDER, MIN_COUNT = 2, 1
LEVEL_BASE, HASHES, BITS = 1.25, 4, 8
#: Bytes up to which the filter is broadcast; each worker process holds a copy.
MAX_BYTES = 16 << 20
#: Words in the broadcast table of exact counts (12 bytes each).
HOT_WORDS = 500_000
LAMBDA = 0.35
#: Bytes of the key of a longer n-gram: two such meet by chance in one of 2**48, far below the filter's own errors.
GRAM_BYTES = 6
U = W.U
BEGIN = U(0x3C79AC492BA7B653)


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    lo = np.ceil(LEVEL_BASE ** (level - 1.0) - 1e-9)
    hi = np.maximum(np.ceil(LEVEL_BASE**level.astype(float) - 1e-9) - 1, lo)
    return np.where(level > 0, (lo + hi) / 2, 0.0)


def token_stream(b: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a block, each text's words and one end; and where each text begins."""
    at = b.ptr + np.arange(b.n + 1)
    tok = np.full(len(b.word) + b.n, W.END, U)
    tok[np.arange(len(b.word)) + b.doc_of_word()] = b.word
    return tok, at


def grams(tok: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-gram that ends at each token, for n = 1 .. order; histories are padded with BEGIN. Longer ones have GRAM_BYTES."""
    place = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
    out = [tok]
    for n in range(2, order + 1):
        h = np.full(len(tok), U(n), U)
        for back in range(n - 1, -1, -1):
            w = np.where(place >= back, np.roll(tok, back), BEGIN)
            h = h * U(0x9E3779B97F4A7C15) + w
        out.append(W.mix(h) >> U(64 - 8 * GRAM_BYTES) << U(64 - 8 * GRAM_BYTES))
    return out


def packed_keys(keys: np.ndarray, at: np.ndarray, order: int) -> pa.Array:
    """Binary array of slices of keys, without the bytes that are 0."""
    if order == 1:
        return blobs(keys, at)
    own = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 8 - GRAM_BYTES :])
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * GRAM_BYTES).astype(np.int32)), pa.py_buffer(own)])


def unpacked_keys(raw: bytes, order: int) -> np.ndarray:
    if order == 1:
        return np.frombuffer(raw, U)
    out = np.zeros((len(raw) // GRAM_BYTES, 8), np.uint8)
    out[:, 8 - GRAM_BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, GRAM_BYTES)
    return out.view(U).ravel()


def slots(keys: np.ndarray, level: np.ndarray | int, order: int, size: np.ndarray) -> list[np.ndarray]:
    """Bit positions of (key, level) in segments of the given sizes."""
    g = W.mix(keys + np.atleast_1d(level).astype(U) * U(0xD1B54A32D192ED03) + U(order * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF))
    a, step = (g >> U(32)).astype(np.int64), (g & U(0xFFFFFFFF)).astype(np.int64) | 1
    return [(a + i * step) % size for i in range(HASHES)]


def probe(base: np.ndarray, filt: np.ndarray, bits: int, keys: np.ndarray, order: int, top: int, most: np.ndarray | None = None) -> np.ndarray:
    """Quantised counts by probing upward, to level ``top`` or an n-gram's ``most``; ``base`` is where each segment begins, with the end."""
    out = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys)) if most is None else np.flatnonzero(most > 0)
    seg = (keys >> U(64 - bits)).astype(np.int64)
    for j in range(1, top + 1):
        k, s = keys[live], seg[live]
        size = (base[s + 1] - base[s]) * 8
        has = size > 0
        live, k, s, size = live[has], k[has], s[has], size[has]
        if not len(live):
            break
        hit = np.ones(len(live), bool)
        for pos in slots(k, j, order, size):
            byte = filt[base[s] + (pos >> 3)]
            hit &= (byte >> (pos & 7).astype(np.uint8)) & 1 == 1
        live = live[hit]
        out[live] = j
        if most is not None:
            live = live[most[live] > j]
    return out


@dataclass
class Model:
    """Broadcast to the workers: 13 bytes a hot word, a few totals, and the filter where it fits (else it is empty)."""

    order: int
    bits: int
    base: np.ndarray  # of each segment, in bytes, with the end
    filter: np.ndarray
    hot: np.ndarray
    hot_count: np.ndarray
    hot_level: np.ndarray  # as probed where the filter was built
    tokens: int
    vocabulary: int
    texts: int
    top: int  # level of the largest count
    filter_bytes: int  # of all segments, held here or not

    @property
    def whole(self) -> bool:
        return len(self.filter) == self.filter_bytes

    def known(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is in the table of frequent words, and its place there."""
        if not len(self.hot):
            return np.zeros(len(tok), bool), np.zeros(len(tok), np.int64)
        i = np.minimum(np.searchsorted(self.hot, tok), len(self.hot) - 1)
        return self.hot[i] == tok, i

    def levels(self, keys: np.ndarray, order: int, most: np.ndarray | None = None) -> np.ndarray:
        """Levels of distinct n-grams from the broadcast filter."""
        return probe(self.base, self.filter, self.bits, keys, order, self.top, most)

    def word_levels(self, tok: np.ndarray, found) -> np.ndarray:
        """Quantised counts of tokens; ``found`` gives those of distinct words that are not in the table."""
        hit, i = self.known(tok)
        out = np.zeros(len(tok), np.int64)
        out[hit] = self.hot_level[i[hit]]
        u, back = np.unique(tok[~hit], return_inverse=True)
        out[~hit] = found(u, 1, None)[back]
        return out

    def log10_probability(self, tok: np.ndarray, at: np.ndarray, found=None) -> np.ndarray:
        """Of each token given its history; ``found(keys, order, most)`` gives levels of distinct n-grams, by default from the filter here."""
        found = found or self.levels
        keys = grams(tok, at, self.order)
        level = self.word_levels(tok, found)
        p = np.minimum((count_of(level) + 1) / (self.tokens + self.vocabulary + 1), 1.0)  # a quantised count may lie above the total
        begins = np.zeros(len(tok), bool)
        begins[at[:-1][at[:-1] < len(tok)]] = True
        history, before = np.where(begins, self.texts, np.roll(count_of(level), 1)), np.where(begins, 1 << 30, np.roll(level, 1))
        for n in range(2, self.order + 1):
            most = np.minimum(before, level)  # an n-gram's level is at most its parts'
            u, first, back = np.unique(keys[n - 1], return_index=True, return_inverse=True)
            level = found(u, n, most[first])[back]
            c = count_of(level)
            ratio = np.minimum(np.divide(c, history, out=np.zeros(len(c)), where=history > 0), 1.0)
            p = np.where(history > 0, LAMBDA * ratio + (1 - LAMBDA) * p, p)
            history, before = np.where(begins, 0, np.roll(c, 1)), np.where(begins, 0, np.roll(level, 1))
        return np.log10(p)


_BLOBS = "kind int, seg int, keys binary, counts binary, levels binary"
_NAMES = ["kind", "seg", "keys", "counts", "levels"]


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, levels: np.ndarray | None = None):
    """One row for each segment; counts go in one, four or eight bytes, as the largest of a segment needs."""
    seg, at = cut(keys, bits)
    if len(seg):
        largest = np.maximum.reduceat(counts, at[:-1])
        for kind_of, here in (("<u1", largest < 1 << 8), ("<u4", (largest >= 1 << 8) & (largest < 1 << 32)), ("<i8", largest >= 1 << 32)):
            if here.any():
                narrow = blobs(np.minimum(counts, np.iinfo(kind_of).max).astype(kind_of), at).filter(pa.array(here))
                own = pa.nulls(int(here.sum()), pa.binary()) if levels is None else blobs(levels, at).filter(pa.array(here))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(narrow), kind), pa.int32()), pa.array(seg[here], pa.int32()), packed_keys(keys, at, kind).filter(pa.array(here)), narrow, own], names=_NAMES)


def _numbers(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, {n: "<u1", 4 * n: "<u4"}.get(len(counts), "<i8")).astype(np.int64)


def _counted(batch: pa.RecordBatch, kind: int) -> tuple[np.ndarray, np.ndarray]:
    k, c = [], []
    for which, keys, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        if which == kind:
            k.append(unpacked_keys(keys, kind))
            c.append(_numbers(counts, len(k[-1])))
    return (np.concatenate(k), np.concatenate(c)) if k else (np.zeros(0, U), np.zeros(0, np.int64))


def count_grams(train: DataFrame, text: str, bits: int, order: int) -> DataFrame:
    """Each task's sums of n-grams, by segment; ``text`` is binary."""

    def run(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        n = 0

        def flush():
            for k, keys in enumerate(held):
                if keys:
                    yield from _rows(k + 1, *sum_by_key(np.concatenate(keys)), bits)
                keys.clear()

        for batch in batches:
            for b in W.blocks(batch.column(0), lower=True):
                tok, at = token_stream(b)
                for k, keys in enumerate(grams(tok, at, order)):
                    held[k].append(keys)
                n += len(tok)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        yield from flush()
        give_back()

    return train.select(text).mapInArrow(run, _BLOBS)


def build(counts: DataFrame, bits: int, parts: int, order: int, min_count: int) -> DataFrame:
    """Of the summed n-grams: kind 1, words with exact counts and probed levels; 0, a task's totals; -1, filter segments."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, order + 1):
            got = [_counted(b, k) for b in batches]
            if got:
                items[k] = sum_by_key(np.concatenate([x for x, _ in got]), np.concatenate([c for _, c in got]))
        batches.clear()
        if not items:
            return
        words, c = items[1]
        count_of_word = c
        hist = np.bincount(level_of(c), minlength=256) if len(c) else np.zeros(256, np.int64)
        totals = np.array([c.sum(), len(words), c[words == W.END].sum(), *hist[:256]], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([totals.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=_NAMES)
        need = np.zeros(1 << bits, np.int64)
        kept = []
        for k, (keys, c) in items.items():
            if k > 1:
                keys, c = keys[c >= min_count], c[c >= min_count]
            level = level_of(c)
            seg = (keys >> U(64 - bits)).astype(np.int64)
            need += np.bincount(seg, weights=level, minlength=1 << bits).astype(np.int64)
            kept.append((k, keys, level, seg))
        size = -(-need * BITS // 8)
        base = np.concatenate([[0], np.cumsum(size)])
        bitmap = np.zeros(base[-1] * 8, bool)
        for k, keys, level, seg in kept:
            rep = np.repeat(np.arange(len(keys)), level)
            j = np.arange(len(rep)) - np.repeat(np.cumsum(level) - level, level) + 1
            s = seg[rep]
            for pos in slots(keys[rep], j, k, size[s] * 8):
                bitmap[base[s] * 8 + pos] = True
        packed = np.packbits(bitmap, bitorder="little")
        own = np.flatnonzero(size)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), -1), pa.int32()), pa.array(own, pa.int32()), pa.array([b""] * len(own), pa.binary()), pa.array([packed[base[s] : base[s + 1]].tobytes() for s in own], pa.binary()), pa.nulls(len(own), pa.binary())], names=_NAMES)
        yield from _rows(1, words, count_of_word, bits, np.minimum(probe(base, packed, bits, words, 1, 255), 255).astype(np.uint8))
        del items, kept, bitmap, packed
        give_back()

    return dealt(counts, parts, bits).mapInArrow(run, _BLOBS)


def segments(saved: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Base and bytes of the whole filter."""
    rows = saved.where("kind = -1").select("seg", "counts").toArrow()
    seg, parts = rows.column(0).to_numpy(), rows.column(1).to_pylist()
    size = np.zeros(1 << bits, np.int64)
    size[seg] = [len(x) for x in parts]
    return np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(parts[i] for i in np.argsort(seg)), np.uint8)


def train(ws: Workspace, docs: DataFrame, text: str, parts: int, order: int = ORDER, min_count: int = MIN_COUNT, max_bytes: int = MAX_BYTES, hot_words: int = HOT_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the saved table whose rows of kind 1 hold all words' exact counts and of kind -1 the filter."""
    bits = segment_bits(parts)
    saved = ws.save(build(count_grams(docs, text, bits, order), bits, parts, order, min_count), "grams")
    total = np.zeros(259, np.int64)
    for r in saved.where("kind = 0").select("counts").toArrow().column(0).to_pylist():
        total += np.frombuffer(r, np.int64)
    above = np.cumsum(total[3:][::-1])[::-1]  # words of a level or more
    least = int(np.flatnonzero(np.append(above, 0) <= hot_words)[0])
    top = int(np.flatnonzero(total[3:]).max(initial=0))
    size = saved.where("kind = -1").select(F.coalesce(F.sum(F.length("counts").cast("long")), F.lit(0))).first()[0]
    base, filt = segments(saved, bits) if size <= max_bytes else (np.zeros((1 << bits) + 1, np.int64), np.zeros(0, np.uint8))

    def hot(batches):
        for b in batches:
            k, c = _counted(b, 1)
            often = level_of(c) >= least
            v = joined(b.column(4), np.uint8)[often]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (k[often], c[often], v)], names=["keys", "counts", "levels"])

    most = saved.where("kind = 1").mapInArrow(hot, "keys binary, counts binary, levels binary").toArrow()
    keys, counts, levels = joined(most.column(0), U), joined(most.column(1), np.int64), joined(most.column(2), np.uint8)
    o = np.argsort(keys)
    return Model(order, bits, base, filt, keys[o], counts[o], np.minimum(levels[o], top).astype(np.int64), int(total[0]), int(total[1]), int(total[2]), top, int(size)), saved


def _whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all of a chunk's texts, and where each text begins."""
    tok, at = zip(*(token_stream(b) for b in W.blocks(texts, lower=True)), strict=True)
    n = np.concatenate([np.diff(x) for x in at])
    return np.concatenate(tok), np.concatenate([[0], np.cumsum(n)])


def routed(ws: Workspace, plain: DataFrame, shared, saved: DataFrame, parts: int) -> DataFrame:
    """(body, found): chunks of the rows of ``plain`` (its last column is the text) and the levels of each one's distinct n-grams.

    Chunks are Arrow batches and kept, so that the passes over them see the same ones. Of each chunk and order the
    distinct n-grams are asked for in ascending order; hot words are known already.
    """
    spark, order, bits, top = ws.spark, shared.value.order, shared.value.bits, shared.value.top

    def pack(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "body"])
                chunk += 1

    chunks = ws.save(plain.mapInArrow(pack, "chunk long, body binary"), "chunks")

    def ask(batches):
        m = shared.value
        for b in batches:
            for chunk, body in zip(b.column(0), b.column(1), strict=True):
                batch = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
                tok, at = _whole(batch.column(batch.num_columns - 1))
                for n, keys in enumerate(grams(tok, at, order), 1):
                    keys = np.unique(keys[~m.known(keys)[0]] if n == 1 else keys)
                    seg, cuts = cut(keys, bits)
                    z = len(seg)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(z, n + 1), pa.int32()), pa.array(seg, pa.int32()), packed_keys(keys, cuts, n), pa.array(np.full(z, chunk.as_py()), pa.int64())], names=["kind", "seg", "keys", "chunk"])
        give_back()

    def answer(batches):
        batches = [b for b in batches if b.num_rows]
        held = {s: np.frombuffer(f, np.uint8) for b in batches for k, s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if k == -1}
        base = np.zeros((1 << bits) + 1, np.int64)
        for s, f in held.items():
            base[s + 1] = len(f)
        base, filt = np.cumsum(base), np.concatenate([held[s] for s in sorted(held)] or [np.zeros(0, np.uint8)])
        for b in batches:
            kind, keys = b.column(0).to_numpy(), b.column(2)
            for n in range(1, order + 1):
                own = np.flatnonzero(kind == n + 1)
                if len(own):
                    raw = [keys[i].as_py() for i in own.tolist()]
                    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]) // (8 if n == 1 else GRAM_BYTES)
                    level = probe(base, filt, bits, unpacked_keys(b"".join(raw), n), n, top)
                    yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(own)), pa.array(np.full(len(own), n), pa.int32()), b.column(1).take(pa.array(own)), blobs(level.astype(np.uint8), at)], names=["chunk", "n", "seg", "levels"])
        give_back()

    asked = chunks.mapInArrow(ask, "kind int, seg int, keys binary, chunk long")
    here = saved.where("kind = -1").select("kind", "seg", F.col("counts").alias("keys"), F.lit(None).cast("long").alias("chunk"))
    found = dealt(here.unionAll(asked), parts, bits).mapInArrow(answer, "chunk long, n int, seg int, levels binary")
    found = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("n", "seg", "levels"))).alias("found"))
    return chunks.join(found, "chunk", "left").select("body", "found")


def _lookup(found: list[dict] | None, order: int):
    """The chunk's levels as a function of distinct n-grams, which come back in the order asked."""
    parts = {n: joined(pa.array([x["levels"] for x in found or () if x["n"] == n], pa.binary()), np.uint8).astype(np.int64) for n in range(1, order + 1)}
    return lambda keys, n, most: parts[n] if most is None else np.minimum(parts[n], most)


def score(ws: Workspace, docs: DataFrame, keep: list[str], text: str, model: Model, saved: DataFrame, parts: int) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score and score, a row for each row of docs."""
    plain = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t"))
    kinds = ", ".join(f"k{i} {t}" for i, (_, t) in enumerate(docs.select(*keep).dtypes))
    nk = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = plain if model.whole else routed(ws, plain, shared, saved, parts)

    def batches_of(batches):
        """(rows, blocks of them, levels): whole chunks as one block where levels came by shuffle."""
        for batch in batches:
            if model_here(batch):
                yield batch, [(b.first, b.n, *token_stream(b)) for b in W.blocks(batch.column(nk), lower=True)], None
                continue
            for body, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
                yield rows, [(0, rows.num_rows, *_whole(rows.column(nk)))], _lookup(found, shared.value.order)

    def model_here(batch) -> bool:
        return batch.schema.names[0] != "body"

    def run(batches):
        from pyspark import TaskContext

        m = shared.value
        logs = np.log10(m.hot_count + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch, parts_of, found in batches_of(batches):
            stats, rare_k, rare_r = [], [], []
            for first, count, tok, at in parts_of:
                known, i = m.known(tok)
                term = np.zeros(len(tok))
                term[known] = logs[i[known]]
                p = m.log10_probability(tok, at, found)
                stats.append(np.stack([np.diff(at), np.add.reduceat(known, at[:-1]), np.add.reduceat(term, at[:-1]), np.add.reduceat(p, at[:-1])]))
                doc = np.repeat(np.arange(count), np.diff(at)) + row + first
                rare_k.append(tok[~known])
                rare_r.append(doc[~known])
            n = batch.num_rows
            if not n:
                continue
            s = np.concatenate(stats, axis=1)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:nk], pa.array(np.arange(row, row + n)), pa.array(s[0].astype(np.int64)), pa.array(s[1].astype(np.int64)), pa.array(s[2]), pa.array(s[3]), pa.nulls(n, pa.int32()), none, none], names=names)
            k, r = np.concatenate(rare_k), np.concatenate(rare_r)
            o = np.argsort(k, kind="stable")
            k, r = k[o], r[o]
            seg, at = cut(k, m.bits)
            if len(seg):
                z = len(seg)
                blank = [pa.nulls(z, f.type) for f in batch.schema][:nk]
                yield pa.RecordBatch.from_arrays([*blank, *(pa.nulls(z, x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(seg, pa.int32()), blobs(k, at), blobs(r, at)], names=names)
            row += n

    names = [*(f"k{i}" for i in range(nk)), "row", "n_tokens", "hot", "term", "score", "seg", "keys", "rows"]
    out = ws.save(source.mapInArrow(run, f"{kinds}, row long, n_tokens long, hot long, term double, score double, seg int, keys binary, rows binary"), "scored")
    ws.drop("chunks")
    asked = out.where("seg IS NOT NULL").select(F.lit(0).alias("kind"), "seg", "keys", F.col("rows").alias("counts"))

    def resolve(batches):
        batches = [b for b in batches if b.num_rows]
        words = [_counted(b, 1) for b in batches]
        if not words:
            return
        wk, wc = (np.concatenate(x) for x in zip(*words, strict=True))
        o = np.argsort(wk)
        wk, wc = wk[o], wc[o]
        k = np.concatenate([np.frombuffer(x, U) for b in batches for q, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if q == 0] or [np.zeros(0, U)])
        r = np.concatenate([np.frombuffer(x, np.int64) for b in batches for q, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True) if q == 0] or [np.zeros(0, np.int64)])
        if not len(k) or not len(wk):
            return
        i = np.minimum(np.searchsorted(wk, k), len(wk) - 1)
        hit = wk[i] == k
        r, term = r[hit], np.log10(wc[i[hit]] + 1.0)
        o = np.argsort(r, kind="stable")
        r, term = r[o], term[o]
        if len(r):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(np.add.reduceat(term, first)), pa.array(np.diff(np.append(first, len(r))))], names=["row", "more", "known"])

    exact = saved.where("kind = 1").select("kind", "seg", "keys", "counts").unionAll(asked)
    more = dealt(exact, parts, model.bits).mapInArrow(resolve, "row long, more double, known long").groupBy("row").agg(F.sum("more").alias("more"), F.sum("known").alias("known"))
    total = float(np.log10(model.tokens + model.vocabulary + 1.0))
    zero = F.lit(0)
    j = out.where("seg IS NULL").join(more, "row", "left")
    return j.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        "n_tokens",
        (F.col("hot") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("term") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        "score",
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op1_lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Base and model log10 probabilities of every whole text.

    A null or empty text is the end token alone. A null doc_id is training data. Repeated
    rows count and are scored each. An empty table gives no rows; without training rows every
    count is 0. Extra columns are ignored. Words are identified by 64-bit hashes. A very long
    text is scored whole in one task, which holds its tokens.
    """
    ws = Workspace(docs.sparkSession)
    parts = reduce_width(docs)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), binary_text("text").alias("t"))
    model, saved = train(ws, d.where("NOT held_out"), "t", parts, order)
    return score(ws, d, ["doc_id", "held_out"], "t", model, saved, parts)
