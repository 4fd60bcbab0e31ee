"""Similarity join of documents on word shingles: every pair of sets with Jaccard similarity of at least 0.8.

Equal sets become one node first. Candidates share a token of their prefixes: with tokens in
one global order, sets that are similar enough must meet in their first n - ceil(0.8 n) + 1.
The order puts frequent tokens last (any order is exact; this one keeps groups small). Within
a token's group sets are banded by size, and only those within the ratio of sizes and
with enough tokens left after the shared one are paired. Hashed bitmap signatures, as wide
as the set's size band, bound the overlap from above by bit counts; what passes is decided by
exact intersection of the sorted arrays.

First only neighbours in each group are compared, which connects many near copies by a
chain; then all remaining pairs between different components. Small groups list their pairs.
Members of large groups are cut into tiles by size band and compared tile by tile, so their
pairs are never rows. The tiles of one band and those of the same or the next band make a grid
that is dealt out in cells of SIDE by SIDE tiles: a tile is sent once for each cell of its row
or column, a task holds a cell's tiles, and only the links that join two components come out.
The cells are dealt in rounds that send no more bytes than the input has, so a large grid takes
more rounds and not more disk. No link between components is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components, meet
from .lm import level_of
from .segments import FLUSH, blobs, dealt, give_back, joined, segment_bits, sum_by_key
from .store import Workspace, binary_text, input_bytes, reduce_width

K, NUM, DEN = 5, 80, 100
#: The count from which a token is frequent, and the most of them that are broadcast (8 bytes each; the most frequent ones).
FREQUENT, MAX_FREQUENT = 40, 2_000_000
#: Sets of a token's group from which it is compared in tiles (above FREQUENT: groups of chance, which would tie the corpus into
#: one cluster, list their pairs), sets and tokens of a tile (on average), and the ratio of sizes that a band spans: above
#: 1 / 0.8, so that similar sets lie in one band or in adjacent ones.
LARGE, TILE, TILE_TOKENS, BAND = 64, 256, 500_000, 1.26
#: Tiles on each side of a cell, and the least bytes of tiles that one round deals out (else as many as the input has).
SIDE, ROUND_BYTES = 4, 256 << 20
#: Rows up to which an id list is broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 1_000_000
U = W.U


def fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One value for each set, whatever the order; 0 only by chance."""
    c = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(h ^ U(0x6A09E667F3BCC909)), dtype=U)])
    return W.mix(c[at[1:]] - c[at[:-1]] + np.diff(at).astype(U) * U(0x9FB21C651E98DF25)).view(np.int64)


def new_sets(fp: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """Non-empty sets that this task has not met yet; ``seen`` stays bounded, a miss only costs work."""
    out = np.zeros(len(fp), bool)
    if len(seen) > 2_000_000:
        seen.clear()
    for i, x in enumerate(fp.tolist()):
        if n[i] and x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _chosen(h: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the chosen sets, and the set that each belongs to."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    m = which[owner]
    return h[m], owner[m]


def short_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """Segment and 32 more bits: enough for grouping, candidates are verified anyway."""
    return h >> U(32 - bits)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def _by_segment(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    seg = (key >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.zeros(0, np.int64)
    return seg[first], np.append(first, len(key))


def frequent_tokens(ws: Workspace, docs: DataFrame, bits: int, parts: int) -> np.ndarray:
    """Sorted short keys of the frequent tokens, at most MAX_FREQUENT of them. All are counted: one that is not would stay early in the order, and a document of common lines would meet all others of them."""

    def count(batches):
        held, n, seen = [], 0, set()

        def flush():
            key, c = sum_by_key(np.concatenate(held))
            seg, at = _by_segment(key, bits)
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), blobs(key.astype("<u4"), at), blobs(np.minimum(c, 65535).astype("<u2"), at)], names=["seg", "keys", "counts"])

        for batch in batches:
            for b in W.blocks(batch.column(0), lower=True):
                h, at = b.shingle_sets(K)
                h, _ = _chosen(h, at, new_sets(fingerprints(h, at), np.diff(at), seen))
                held.append(short_keys(h, bits))
                n += len(held[-1])
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()
        give_back()

    def total(batches):
        key, c = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for b in batches:
            for seg, k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key.append((U(seg) << U(32)) | np.frombuffer(k, "<u4").astype(U))
                c.append(np.frombuffer(m, "<u2").astype(np.int64))
        key, c = sum_by_key(np.concatenate(key), np.concatenate(c))
        key, c = key[c >= FREQUENT], c[c >= FREQUENT]
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([np.bincount(level_of(c), minlength=256).tobytes()], pa.binary())], names=["keys", "counts", "hist"])

    found = ws.save(dealt(docs.select("t").mapInArrow(count, "seg int, keys binary, counts binary"), parts, bits).mapInArrow(total, "keys binary, counts binary, hist binary"), "frequent")
    hist = np.zeros(256, np.int64)
    for x in found.select("hist").toArrow().column(0).to_pylist():
        hist += np.frombuffer(x, np.int64)[:256]
    least = int(np.flatnonzero(np.append(np.cumsum(hist[::-1])[::-1], 0) <= MAX_FREQUENT)[0])

    def top(batches):
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, c = np.frombuffer(k, U), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k[level_of(c) >= least].tobytes()], pa.binary())], names=["keys"])

    return np.sort(joined(found.select("keys", "counts").mapInArrow(top, "keys binary").toArrow().column(0), U))


def enough(na, nb, pa_, pb):
    """Sizes na <= nb and places of a shared token that still allow a similar pair."""
    need = (NUM * (na + nb) + NUM + DEN - 1) // (NUM + DEN)
    return (DEN * na >= NUM * nb) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= need)


_SHARED = "keys binary, fps binary, ns binary, at binary, a binary, b binary"


def shared_tokens(docs: DataFrame, frequent: np.ndarray, bits: int, parts: int) -> DataFrame:
    """Prefix tokens that two or more different sets hold, and the neighbouring pairs of each."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        hot, seen = known.value, set()
        held: list[tuple] = []

        def flush():
            key, fp, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(key, kind="stable")
            key, fp, n, at = key[o], fp[o], n[o], at[o]
            seg, cuts = _by_segment(key, bits)
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), blobs(key.astype("<u4"), cuts), blobs(fp, cuts), blobs(n.astype("<i4"), cuts), blobs(np.minimum(at, 65535).astype("<u2"), cuts)], names=["seg", "keys", "fps", "ns", "at"])

        size = 0
        for batch in batches:
            for b in W.blocks(batch.column(0), lower=True):
                h, at = b.shingle_sets(K)
                fp, n = fingerprints(h, at), np.diff(at)
                h, owner = _chosen(h, at, new_sets(fp, n, seen))
                key = short_keys(h, bits)
                late = np.zeros(len(h), np.int64)
                if len(hot):
                    late[hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key] = 1
                o = np.argsort(owner * 2 + late, kind="stable")  # tokens are in hash order already
                key, owner = key[o], owner[o]
                place = np.arange(len(key)) - np.searchsorted(owner, owner)
                m = place < prefix_length(n)[owner]
                held.append((key[m], fp[owner[m]], n[owner[m]], place[m]))
                size += int(m.sum())
                if size > FLUSH // 4:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        held.clear()
        give_back()

    def meet(batches):
        cols: list[list] = [[], [], [], []]
        for b in batches:
            seg = b.column(0).to_pylist()
            for s, k, f, n, p in zip(seg, *(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                cols[0].append((U(s) << U(32)) | np.frombuffer(k, "<u4").astype(U))
                cols[1].append(np.frombuffer(f, "<i8"))
                cols[2].append(np.frombuffer(n, "<i4").astype(np.int64))
                cols[3].append(np.frombuffer(p, "<u2").astype(np.int64))
        if not cols[0]:
            return
        key, fp, n, at = (np.concatenate(x) for x in cols)
        o = np.lexsort((fp, n, key))
        key, fp, n, at = key[o], fp[o], n[o], at[o]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
        key, fp, n, at = key[new], fp[new], n[new], at[new]
        same = key[1:] == key[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, fp, n, at = key[many], fp[many], n[many], at[many]
        if not len(key):
            return
        i = np.flatnonzero((key[1:] == key[:-1]) & enough(n[:-1], n[1:], at[:-1], at[1:]))
        pairs = np.unique(np.stack([np.minimum(fp[i], fp[i + 1]), np.maximum(fp[i], fp[i + 1])], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (key, fp, n, at, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))], names=["keys", "fps", "ns", "at", "a", "b"])
        cols.clear()
        give_back()

    return dealt(docs.select("t").mapInArrow(emit, "seg int, keys binary, fps binary, ns binary, at binary"), parts, bits).mapInArrow(meet, _SHARED)


def _unpack(df: DataFrame, names: list[str], out: list[str]) -> DataFrame:
    """Rows of the 64-bit values that blobs hold side by side."""

    def run(batches):
        for b in batches:
            for blob in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
                cols = [np.frombuffer(x, np.int64) for x in blob]
                for lo in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in cols], names=out)

    return df.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in out))


def signature(h: np.ndarray) -> bytes:
    """A bitmap with at least two bits for each token, a power of two of them, at least 64."""
    width = max(64, 1 << int(2 * len(h) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(h & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """At most this many tokens are common: a token whose bit the other lacks is not."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, fp, sig) of every row; an empty set has n 0 and null fp and sig."""

    def run(batches):
        for batch in batches:
            ns, fps, sigs = [], [], []
            for b in W.blocks(batch.column(1), lower=True):
                h, at = b.shingle_sets(K)
                n, fp = np.diff(at), fingerprints(h, at)
                ns += n.tolist()
                fps += [x if m else None for x, m in zip(fp.tolist(), n.tolist(), strict=True)]
                sigs += [signature(h[at[i] : at[i + 1]]) if n[i] else None for i in range(b.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "h", "n", "fp", "sig"])
        give_back()

    return docs.select("doc_id", "t", "h").mapInArrow(run, "doc_id long, h long, n long, fp long, sig binary")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Verifier:
    """Decides pairs of nodes: bit counts first, exact intersection for what they let through."""

    def __init__(self, ws: Workspace, docs: DataFrame, nodes: DataFrame):
        self.ws, self.docs, self.nodes = ws, docs, nodes

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar."""
        ws, side = self.ws, lambda c: self.nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))

        def bound(batches):
            for b in batches:
                a, c, na, nb = (b.column(n).to_numpy() for n in ("a", "b", "na", "nb"))
                best = np.array([overlap_bound(x, y, p, q) for x, y, p, q in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), na.tolist(), nb.tolist(), strict=True)], np.int64)
                ok = DEN * best >= NUM * (na + nb - best)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], names=["a", "b"])

            give_back()

        likely = ws.save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bound, "a long, b long"), f"{name}-likely")
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), name)

        def exact(batches):
            for b in batches:
                out = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                    i = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[i] == x).sum())
                    out.append(DEN * common >= NUM * (len(x) + len(y) - common))
                m = pa.array(out, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], names=["a", "b"])
            give_back()

        both = likely.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
        found = ws.save(both.mapInArrow(exact, "a long, b long"), f"{name}-links")
        ws.drop(f"{name}-likely", f"{name}-ends")
        return found

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """(fp, set): the sorted tokens of the wanted nodes, made again from the texts that name them."""
        reps = self.ws.save(wanted.join(self.nodes, "fp").select(F.col("doc_id").alias("rep")).distinct(), f"{name}-ends")
        texts = self.docs.join(_small(reps), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("t")

        def arrays(batches):
            for batch in batches:
                for b in W.blocks(batch.column(0), lower=True):
                    h, at = b.shingle_sets(K)
                    yield pa.RecordBatch.from_arrays([pa.array(fingerprints(h, at)), blobs(h, at)], names=["fp", "set"])
            give_back()

        return texts.mapInArrow(arrays, "fp long, set binary").dropDuplicates(["fp"])

    def tile_links(self, members: DataFrame, clusters: DataFrame, name: str) -> DataFrame:
        """Links (a, b) that join components of members (fp, n, label), among those of one cluster."""
        ws = self.ws
        m = members.join(clusters.select(F.col("node").alias("fp"), F.col("component").alias("cluster")), "fp")
        m = m.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int"))
        m, size = ws.measured(m.withColumn("group", F.xxhash64("cluster", "band")), f"{name}-members", rows=F.count(F.lit(1)))
        counts = m.groupBy("group", "cluster", "band").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_TOKENS)).alias("tiles"), F.count("*").alias("rows"), F.sum("n").alias("tokens"))
        counts = ws.save(counts, f"{name}-counts")
        m = meet(m.drop("cluster", "band"), counts.drop("tokens"), "group", "rows", size["rows"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        m = m.join(self.sets(members.select("fp"), name), "fp")

        def pack(table: pa.Table) -> pa.Table:
            sets = table.column("set").to_pylist()
            at = np.cumsum([0, *(len(x) // 8 for x in sets)])
            first = table.slice(0, 1)
            blob = [table.column("fp").to_numpy().tobytes(), table.column("label").to_numpy().tobytes(), at.astype(np.int64).tobytes(), b"".join(sets)]
            return pa.table({**{c: first.column(c) for c in ("cluster", "band", "t")}, **{c: pa.array([x], pa.binary()) for c, x in zip(("fps", "labels", "at", "sets"), blob, strict=True)}})

        schema = "cluster long, band int, t int, fps binary, labels binary, at binary, sets binary"
        tiles = ws.save(m.select("cluster", "band", "t", "fp", "label", "set").groupBy("cluster", "band", "t").applyInArrow(pack, schema), f"{name}-tiles")
        sides = counts.select("cluster", "band", "tiles", F.ceil(F.col("tiles") / SIDE).cast("int").alias("side"))
        beside = lambda by, c: sides.select("cluster", (F.col("band") + by).alias("band"), F.col("side").alias(c))
        place = F.floor(F.col("t") * F.col("side") / F.col("tiles")).cast("int")  # rises with t
        dealt_tiles = tiles.join(sides, ["cluster", "band"]).withColumn("place", place)
        none = F.array().cast("array<struct<other: int, k: int>>")

        def places(first, last, other: str, band) -> F.Column:
            own = F.transform(F.sequence(first, last), lambda k: F.struct(F.col("band").alias("other"), k.alias("k")))
            return F.concat(own, F.when(F.col(other).isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: F.struct(band.alias("other"), k.alias("k")))))

        # x lies in a row of its band's grid and goes to the columns from the diagonal on, y in a column and goes to the rows up to it;
        # between two bands they go to all
        x = dealt_tiles.join(beside(-1, "above"), ["cluster", "band"], "left").withColumn("p", F.explode(places(F.col("place"), F.col("side") - 1, "above", F.col("band") + 1)))
        x = x.select("cluster", "band", F.col("p.other").alias("own"), F.col("place").alias("i"), F.col("p.k").alias("j"), "t", *(F.col(c).alias(f"x_{c}") for c in ("fps", "labels", "at", "sets")))
        y = dealt_tiles.join(beside(1, "below"), ["cluster", "band"], "left").withColumn("p", F.explode(places(F.lit(0), F.col("place"), "below", F.col("band") - 1)))
        y = y.select("cluster", F.col("p.other").alias("band"), F.col("band").alias("own"), F.col("p.k").alias("i"), F.col("place").alias("j"), F.col("t").alias("u"), *(F.col(c).alias(f"y_{c}") for c in ("fps", "labels", "at", "sets")))
        cell = ["cluster", "band", "own", "i", "j"]
        sent = sides.join(beside(-1, "above"), ["cluster", "band"], "left").join(beside(1, "below"), ["cluster", "band"], "left").join(counts.select("cluster", "band", "tokens"), ["cluster", "band"])
        sent = sent.agg(F.sum(8 * F.col("tokens").cast("double") * (1 + F.col("side") + F.coalesce("above", F.lit(0)) + F.coalesce("below", F.lit(0))))).first()[0] or 0
        rounds = max(1, math.ceil(sent / max(input_bytes(self.docs), ROUND_BYTES)))

        def cells(k: int) -> DataFrame:
            own = [s if rounds == 1 else s.where(F.pmod(F.xxhash64(*cell), F.lit(rounds)) == k) for s in (x, y)]
            return own[0].join(own[1], cell).where((F.col("own") > F.col("band")) | (F.col("u") >= F.col("t"))).drop(*cell, "t", "u")

        def compare(batches):
            for b in batches:
                for row in b.to_pylist():
                    links = tile_pairs(*([row[f"{s}_{c}"] for c in ("fps", "labels", "at", "sets")] for s in "xy"))
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], names=["a", "b"])
            give_back()

        found = None
        for k in range(rounds):
            links = ws.save(cells(k).mapInArrow(compare, "a long, b long"), f"{name}-links/{k}")
            found = links if found is None else found.unionAll(links)
        ws.drop(*(f"{name}-{x}" for x in ("members", "counts", "ends", "tiles")))
        return found


def tile_pairs(x: list[bytes], y: list[bytes]) -> list[tuple[int, int]]:
    """Links between two tiles that join sets of different labels; pairs already joined are passed over."""
    fx, lx, ax = (np.frombuffer(v, np.int64) for v in x[:3])
    fy, ly, ay = (np.frombuffer(v, np.int64) for v in y[:3])
    hx, hy = np.frombuffer(x[3], U), np.frombuffer(y[3], U)
    nx, ny = np.diff(ax), np.diff(ay)
    width = max(64, 1 << int(2 * max(nx.max(), ny.max()) - 1).bit_length())

    def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(at) - 1, width), bool)
        bits[np.repeat(np.arange(len(at) - 1), np.diff(at)), (h & U(width - 1)).astype(np.int64)] = True
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    sx, sy = signatures(hx, ax), signatures(hy, ay)
    cx, cy = np.bitwise_count(sx).sum(axis=1).astype(np.int64), np.bitwise_count(sy).sum(axis=1).astype(np.int64)
    todo: list[np.ndarray] = []
    for i in range(len(fx)):
        both = np.bitwise_count(sx[i] & sy).sum(axis=1).astype(np.int64)
        most = np.minimum(nx[i] - (cx[i] - both), ny - (cy - both))  # a bit that the other lacks is a token that it lacks
        j = np.flatnonzero((lx[i] != ly) & (DEN * np.minimum(nx[i], ny) >= NUM * np.maximum(nx[i], ny)) & (DEN * most >= NUM * (nx[i] + ny - most)))
        if len(j):
            todo.append(np.stack([np.full(len(j), i), j, -most[j]]))
    if not todo:
        return []
    pairs = np.concatenate(todo, axis=1)
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while v in up:
            if up[v] in up:
                up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for i, j in pairs[:2, np.argsort(pairs[2], kind="stable")].T.tolist():
        p, q = root(int(lx[i])), root(int(ly[j]))
        if p == q:
            continue
        a, b = hx[ax[i] : ax[i + 1]], hy[ay[j] : ay[j + 1]]
        k = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[k] == a).sum())
        if DEN * common >= NUM * (len(a) + len(b) - common):
            up[p] = q
            out.append((int(fx[i]), int(fy[j])))
    return out


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, component_id, label) of every row of docs.

    h is the text's hash. label is the same for the rows of one component, whatever their ids; it is null for an empty set.
    """
    ws = Workspace(docs.sparkSession)
    parts = reduce_width(docs)
    bits = segment_bits(parts)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text(text).alias("t"))
    sets = ws.save(set_table(d.withColumn("h", F.xxhash64("t"))), "sets")
    nodes = ws.save(sets.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    frequent = frequent_tokens(ws, d, bits, min(3 * parts, 1 << bits))  # a row for each token, of which shared_tokens sends a fifth
    shared = ws.save(shared_tokens(d, frequent, bits, parts), "shared")
    verify = Verifier(ws, d, nodes)

    chains = verify.links(_unpack(shared, ["a", "b"], ["a", "b"]).distinct(), "chain")
    label = ws.save(components(ws, chains, "a", "b", "chain-cc"), "labels")
    held = _unpack(shared, ["keys", "fps", "ns", "at"], ["key", "fp", "n", "at"]).join(label.select(F.col("node").alias("fp"), "component"), "fp", "left")
    held = ws.save(held.select("key", "fp", "n", "at", F.coalesce("component", "fp").alias("label")), "labelled")
    ws.drop("shared")
    mixed = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.min("fp").alias("head")).where("lo <> hi")
    rows = ws.save(held.join(mixed.select("key", "size", "head"), "key"), "mixed")
    ws.drop("labelled")
    large = rows.where(F.col("size") > LARGE)
    members = ws.save(large.select("fp", "n", "label").distinct(), "members")
    rows = rows.where(F.col("size") <= LARGE)
    x, y = rows.alias("x"), rows.alias("y")
    c = {f"{s}{k}": F.col(f"{s}.{k}") for s in "xy" for k in ("n", "fp", "at", "label")}
    need = F.ceil((NUM * (c["xn"] + c["yn"])) / (NUM + DEN))
    cross = x.join(y, "key").where(
        (c["xlabel"] != c["ylabel"])
        & ((c["xn"] < c["yn"]) | ((c["xn"] == c["yn"]) & (c["xfp"] < c["yfp"])))
        & (DEN * c["xn"] >= NUM * c["yn"])
        & (F.least(c["xn"] - c["xat"], c["yn"] - c["yat"]) >= need)
    )
    pairs = cross.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    rest = verify.links(pairs, "rest")

    rep = nodes.select("fp", F.col("doc_id").alias("rep"))
    late = ws.save(rest.unionAll(verify.tile_links(members, components(ws, large, "fp", "head", "tile-cc"), "tile")), "late-links")
    ws.drop("mixed", "members", "rest-links", "tile-links")
    # the chains' components are known: what came later joins their labels, a much smaller graph
    name = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
    between = late.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined_up = ws.save(components(ws, between, "a", "b", "all-cc"), "joined")
    side = _small(joined_up.select(F.col("node").alias("component"), F.col("component").alias("whole")))
    chained = label.join(side, "component", "left").select(F.col("node").alias("fp"), F.coalesce("whole", "component").alias("component"))
    alone = joined_up.select(F.col("node").alias("fp"), "component").join(label.select(F.col("node").alias("fp")), "fp", "left_anti")
    comp, size = ws.measured(chained.unionAll(alone), "components", rows=F.count(F.lit(1)))
    least = ws.save(comp.join(rep, "fp").groupBy("component").agg(F.min("rep").alias("first"), F.count("*").alias("n")), "least")
    first = meet(comp, least, "component", "n", size["rows"]).select("fp", "first", "component")
    of_node = ws.save(rep.join(first, "fp", "left").select("fp", F.coalesce("first", "rep").alias("component_id"), F.coalesce("component", "fp").alias("label")), "node-components")
    ws.drop("nodes", "components", "least")
    out = sets.join(of_node, "fp", "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label")


def op5_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """Set size and component of every document.

    Null, empty and blank texts have empty sets and are linked with nothing. A text of one to
    four words has one shingle. Equal sets share a component. A null doc_id never names a
    component; a group of such rows alone has a null one. Repeated rows repeat. An empty table gives
    no rows; extra columns are ignored. A very long text is one set, held whole by a task. Shingles
    are identified by 64-bit hashes.
    """
    return near_groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest doc_id (nulls last), then text hash.

    Rows are told apart by doc_id and text hash, so null and repeated ids cost no other text. Rows that
    share both stay once; rows without words are linked with nothing, and those of a null id all stay.
    """
    ws = Workspace(docs.sparkSession)
    found = ws.save(near_groups(docs), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    linked = found.where("label IS NOT NULL").select("doc_id", "h", "label", key.alias("k"))
    keep = ws.save(linked.groupBy("label").agg(F.min("k").alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("label", "kept"), "kept")
    lost = linked.join(_small(keep), "label").where(~F.col("k").eqNullSafe(F.col("kept")))
    gone = ws.save(lost.select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct(), "gone")
    text_hash = F.xxhash64(binary_text("text"))
    out = docs.join(_small(gone), F.col("doc_id").eqNullSafe(F.col("__gone")) & (text_hash == F.col("__h")), "left_anti")
    repeated = found.where("doc_id IS NOT NULL OR label IS NOT NULL").groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    if not repeated:
        return out
    wordless = F.col("doc_id").isNull() & ~binary_text("text").cast("string").rlike(r"[^\x20\x09-\x0D]")
    own = F.when(wordless, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return out.withColumn("__h", text_hash).withColumn("__own", own).dropDuplicates(["doc_id", "__h", "__own"]).select(*docs.columns)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {K - 1}], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - {K - 1})) AS u(i)
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {K - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {DEN} * c >= {NUM} * (a.n + b.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON x = doc_id
"""
