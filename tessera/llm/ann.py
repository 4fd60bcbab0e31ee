"""Approximate nearest neighbours by inner product over sharded, robust-pruned directed graphs.

A shard's vectors are cut into bands of nearly equal length, and each band has a graph of its
own over the directions, so that neither long vectors nor extreme magnitudes bend the edges.
Vectors are inserted in batches of growing size: a greedy beam search over the graph so far
proposes neighbours, and relaxed pruning drops a neighbour that a kept one already leads to
(ALPHA times nearer), so the kept edges are diverse. Each query walks every shard with a beam,
longest band first; a band is passed over only where its length proves that it holds nothing
near enough. What is found is scored again in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Workspace

#: Distinct vectors of a shard (on average), and queries that are searched together.
SHARD, QUERIES = 4096, 512
DEGREE, BEAM, SEARCH_BEAM, ALPHA, EXPAND = 32, 64, 128, 1.2, 4
#: Longest to shortest length of a band, and the vectors that it holds at least: fewer than a beam, which then sees all of them.
BAND, LEAST = 1.1, 64
TOP = 20


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (32-bit) and lengths; scaled before squaring, so that no magnitude overflows or vanishes."""
    most = np.abs(v).max(axis=1, keepdims=True)
    u = v / most
    size = np.sqrt(np.einsum("ij,ij->i", u, u))
    return (u / size[:, None]).astype(np.float32), size * most[:, 0]


def bands(length: np.ndarray) -> np.ndarray:
    """Where each band of descending lengths begins, with the end."""
    at, n = [0], len(length)
    while (i := at[-1]) < n:
        j = int(np.searchsorted(-length, -length[i] / BAND, side="right"))
        j = max(j, i + LEAST)
        at.append(n if n - j < LEAST else j)
    return np.array(at)


def beam_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam (ids, inner products; best first, -1 where short) of each query after it can improve no more."""
    n = len(q)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    ids = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    first = q @ x[starts].T
    pick = np.argsort(-first, axis=1, kind="stable")[:, :width]
    m = pick.shape[1]
    ids[:, :m], near[:, :m], done[:, :m] = starts[pick], np.take_along_axis(first, pick, 1), False
    seen[rows, ids[:, :m]] = True
    live = np.arange(n)
    while len(live):
        r = np.arange(len(live))[:, None]
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]  # the best that are not yet expanded
        fresh = ~done[live[:, None], pick]
        src = np.where(fresh, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        nb = np.where(src[:, :, None] >= 0, graph[src], -1).reshape(len(live), -1)
        nb = np.sort(nb, axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        nb[seen[live[:, None], nb]] = -1
        seen[live[:, None], nb] = True
        score = np.matmul(x[nb], q[live][:, :, None])[:, :, 0]
        score[nb < 0] = -np.inf
        all_ids = np.concatenate([ids[live], nb], axis=1)
        all_near = np.concatenate([near[live], score], axis=1)
        all_done = np.concatenate([done[live], nb < 0], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        ids[live], near[live] = all_ids[r, top], all_near[r, top]
        done[live] = all_done[r, top] | (ids[live] < 0)
        live = live[~done[live].all(axis=1)]
    return ids, near


def robust_prune(p: np.ndarray, cand: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, up to ``degree`` of its candidates (-1: none), nearest first, each not alpha times nearer to a kept one."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == p[:, None]] = -1
    v = x[cand]
    d = ((v - x[p][:, None, :]) ** 2).sum(axis=2)
    d[cand < 0] = np.inf
    o = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, o, 1), np.take_along_axis(d, o, 1)
    v = x[cand]
    sq = (v**2).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    live = cand >= 0
    out = np.full((len(p), degree), -1, np.int64)
    r = np.arange(len(p))
    for k in range(degree):
        j = live.argmax(axis=1)
        has = live[r, j]
        if not has.any():
            break
        out[has, k] = cand[has, j[has]]
        live &= ~((alpha * alpha * between[r, j] <= d) & has[:, None])
        live[r[has], j[has]] = False
    return out


def build_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges (n, DEGREE), -1 where fewer, and the entry points, from which every node is reached; x are unit vectors."""
    n = len(x)
    graph = np.full((n + 1, DEGREE), -1, np.int64)  # the last row answers to -1
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    for again in (False, True):
        at = 1 if not again else 0
        while at < n:
            size = min(256, n - at) if again else min(max(1, at // 2), 256, n - at)
            p = order[at : at + size]
            found, _ = beam_search(x[p], x, graph, order[:1], BEAM)  # of equal lengths the nearest is that of largest inner product
            cand = np.concatenate([found, graph[p]], axis=1)
            if not again and size > 1:  # points of one batch may be each other's neighbours
                cand = np.concatenate([cand, np.broadcast_to(p[: min(size, 32)], (size, min(size, 32)))], axis=1)
            graph[p] = robust_prune(p, cand, x, DEGREE, ALPHA)
            src, dst = np.repeat(p, DEGREE), graph[p].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            o = np.argsort(dst, kind="stable")
            src, dst = src[o], dst[o]
            q, first, m = np.unique(dst, return_index=True, return_counts=True)
            new = np.full((len(q), min(int(m.max()), 64)) if len(q) else (0, 1), -1, np.int64)
            place = np.arange(len(dst)) - np.repeat(first, m)
            ok = place < new.shape[1]
            new[np.repeat(np.arange(len(q)), m)[ok], place[ok]] = src[ok]
            for lo in range(0, len(q), 512):
                s = slice(lo, lo + 512)
                graph[q[s]] = robust_prune(q[s], np.concatenate([graph[q[s]], new[s]], axis=1), x, DEGREE, ALPHA)
            at += size
    starts, reached = [start], np.zeros(n + 1, bool)
    reached[-1] = True
    while True:
        todo = np.array(starts[-1:])
        while len(todo):
            reached[todo] = True
            todo = np.unique(graph[todo])
            todo = todo[~reached[todo]]
        if reached.all():
            return graph[:n], np.array(starts)
        starts.append(int(np.argmin(reached)))


class Shard:
    """One shard's distinct vectors by descending length, each with the smallest ids of the rows that hold it, and the bands' graphs."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        unit, length = directions(vectors)
        order = np.argsort(-length, kind="stable")
        self.vectors, self.ids = vectors[order], [ids[i] for i in order]
        self.bands, graphs, starts = bands(length[order]), [], []
        for k, (lo, hi) in enumerate(zip(self.bands[:-1], self.bands[1:], strict=True)):
            graph, first = build_graph(unit[order[lo:hi]])
            graphs.append(graph)
            starts += [(k, i) for i in first.tolist()]
        self.graph, self.starts = np.concatenate(graphs), np.array(starts)

    def pack(self) -> tuple[bytes, ...]:
        at = np.cumsum([0, *map(len, self.ids)])
        ids = np.array([i for x in self.ids for i in x], "<i8")
        return tuple(x.tobytes() for x in (self.vectors.astype("<f8"), ids, at.astype("<i8"), self.graph.astype("<i4"), self.bands.astype("<i4"), self.starts.astype("<i4")))


#: What Shard.pack() gives, by name.
PACKED = ("vec", "ids", "at", "graph", "bands", "starts")


def search_shard(dim: int, packed: tuple[bytes, ...], qid: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's ``top`` nearest rows of a shard, as the beam finds them."""
    vec, ids, at, graph, cuts, starts = packed
    v = np.frombuffer(vec, "<f8").reshape(-1, dim)
    ids, at, cuts = np.frombuffer(ids, "<i8"), np.frombuffer(at, "<i8"), np.frombuffer(cuts, "<i4")
    graph, starts = np.frombuffer(graph, "<i4").reshape(len(v), -1), np.frombuffer(starts, "<i4").reshape(-1, 2)
    unit, length = directions(v)
    ask, size = directions(q)
    none = np.zeros(0, np.int64)
    row, vec_id, score = none, none, np.zeros(0)
    least = np.full(len(q), -np.inf)  # each query's score at rank ``top`` so far
    for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        live = np.flatnonzero(size * length[lo] * (1 + 1e-9) >= least)
        if not len(live):
            break  # bands that follow are shorter still
        x = unit[lo:hi] * (length[lo:hi] / length[lo]).astype(np.float32)[:, None]
        g = np.concatenate([graph[lo:hi], np.full((1, DEGREE), -1, np.int32)]).astype(np.int64)
        found, _ = beam_search(ask[live], x, g, starts[starts[:, 0] == k, 1].astype(np.int64), max(SEARCH_BEAM, top + 1))
        r, col = np.nonzero(found >= 0)
        node = found[r, col] + lo
        n = at[node + 1] - at[node]
        r, node = np.repeat(live[r], n), np.repeat(node, n)
        place = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
        i = ids[at[node] + place]
        other = i != qid[r]
        r, node, i = r[other], node[other], i[other]
        row, vec_id, score = np.concatenate([row, r]), np.concatenate([vec_id, i]), np.concatenate([score, np.einsum("ij,ij->i", q[r], v[node])])
        o = np.lexsort((vec_id, -score, row))
        row, vec_id, score = row[o], vec_id[o], score[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < top
        row, vec_id, score = row[best], vec_id[best], score[best]
        full = rank[best] == top - 1
        least[row[full]] = score[full]
    return qid[row], vec_id, score


def usable(embedding) -> F.Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _blocks(vectors: DataFrame, top: int) -> DataFrame:
    """Within each task, equal vectors become one with their ``top`` + 1 smallest ids: no more can be among a query's nearest."""

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([len(k) // 8 for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array([sorted(set(held[k]))[: top + 1] for k in keys], pa.list_(pa.int64()))], names=["dim", "vec", "ids"])

        for b in batches:
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0, b.column(1).value_lengths().to_numpy().cumsum()
            for i, (vec_id, end) in enumerate(zip(b.column(0).to_pylist(), at.tolist(), strict=True)):
                key = flat[at[i - 1] if i else 0 : end].tobytes()
                mine = held.setdefault(key, [])
                mine.append(vec_id)
                if len(mine) > 64 * (top + 1):
                    held[key] = sorted(set(mine))[: top + 1]
            if len(held) > 50_000:
                yield from out()
                held.clear()
        if held:
            yield from out()

    return vectors.mapInArrow(run, "dim int, vec binary, ids array<long>")


def width(spark, shards: int) -> int:
    return max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))


def build_index(ws: Workspace, vectors: DataFrame, top: int, shard_size: int = SHARD) -> tuple[DataFrame, int]:
    """The saved index, a row for each shard and dimension, and the number of shards; every usable row is in it."""
    slim = ws.save(_blocks(vectors, top), "vectors")
    shards = max(1, -(-slim.count() // shard_size))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        held: dict[bytes, list[int]] = {}
        for vec, ids in zip(table.column("vec").to_pylist(), table.column("ids").to_pylist(), strict=True):
            held[vec] = sorted({*held.get(vec, ()), *ids})[: top + 1]
        keys = sorted(held)
        dim = len(keys[0]) // 8
        s = Shard(np.frombuffer(b"".join(keys), "<f8").reshape(-1, dim), [held[k] for k in keys])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(PACKED, s.pack(), strict=True)}})

    dealt = dealt.repartition(width(ws.spark, shards), "dim", "shard")  # a number of its own: merging by bytes would put shards together whose work is in the products
    index = dealt.groupBy("dim", "shard").applyInArrow(run, f"dim int, shard int, {', '.join(f'{c} binary' for c in PACKED)}")
    return ws.save(index, "index"), shards


def query_blocks(queries: DataFrame, shards: int) -> DataFrame:
    """Queries in blobs of up to QUERIES of one dimension, one copy of each for every shard."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def row(dim, ids, vecs):
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vecs)], pa.binary())], names=["dim", "qid", "q"])

        for b in batches:
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                ids, vecs = held.setdefault(len(flat), ([], []))
                ids.append(vec_id)
                vecs.append(flat.tobytes())
                if len(ids) == QUERIES:
                    yield row(len(flat), ids, vecs)
                    del held[len(flat)]
        for dim, (ids, vecs) in held.items():
            yield row(dim, ids, vecs)

    return queries.mapInArrow(run, "dim int, qid binary, q binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def search(index: DataFrame, blocks: DataFrame, shards: int, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of what all shards find."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                q = np.frombuffer(r["q"], "<f8").reshape(-1, r["dim"])
                found = search_shard(r["dim"], tuple(r[c] for c in PACKED), np.frombuffer(r["qid"], "<i8"), q, top)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2])], names=["query_id", "vec_id", "score"])

    met = index.repartition(width(index.sparkSession, shards), "dim", "shard").join(blocks.repartition(width(index.sparkSession, shards), "dim", "shard"), ["dim", "shard"])
    near = met.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_nearest(embeddings: DataFrame, top: int = TOP, every: int = 20, shard_size: int = SHARD) -> DataFrame:
    """The ``top`` nearest of every row whose vec_id is divisible by ``every``, among all other rows.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part,
    nor do rows without a vec_id. Equal vectors share one node of the graph. Vectors with
    different numbers of components are never compared. Repeated rows of one vec_id count once. An empty
    table gives no rows; extra columns are ignored. Ties go to the smaller vec_id.
    """
    ws = Workspace(embeddings.sparkSession)
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    e = e.withColumn("embedding", F.col("embedding").cast("array<double>"))
    index, shards = build_index(ws, e, top, shard_size)
    return search(index, query_blocks(e.where(F.col("vec_id") % every == 0), shards), shards, top)
