"""Hard negatives from k-means inverted lists that are visited by upper bound.

A bounded sample gives the centroids; every row goes into the list of its nearest one. A list is
stored in blocks of bounded size, each with the mean of its rows and their largest distance from it.
By the Cauchy-Schwarz inequality a row's inner product with a query lies within |query| times that radius of the
mean's. A query visits the blocks of a shard by descending upper bound, skips those whose bounds
miss its score window, and stops when the bound falls strictly below the score at the last rank it
keeps. What the shards keep is ranked once more. Scores are exact integers, so the result is that
of comparing all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import meet
from .store import Workspace

#: Rows and bytes at most that k-means is fitted on, and centroids at most.
SAMPLE, SAMPLE_BYTES, CENTROIDS = 8_192, 64 << 20, 512
#: Rows of a block (fewer where vectors are long: BLOCK_BYTES), blocks of a shard on average, queries that are searched together.
BLOCK, BLOCK_BYTES, BLOCKS, QUERIES = 4_096, 16 << 20, 8, 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def kmeans(x: np.ndarray, k: int, steps: int = 10, seed: int = 11) -> np.ndarray:
    """Up to k centroids of the rows of x."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(steps):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if np.array_equal(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centroid."""
    out, sq = np.empty(len(x), np.int64), np.einsum("ij,ij->i", c, c)
    for i in range(0, len(x), 2048):
        out[i : i + 2048] = np.argmin(sq - 2 * (x[i : i + 2048] @ c.T), axis=1)
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; those beyond 64 bits are the nearest 64-bit value."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)  # every partial sum is an exact integer
    if most < 2.0**62:
        return q @ v.T
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


class Best:
    """The k best (score descending, then id ascending) of each query and window."""

    def __init__(self, queries: int, windows: int, k: int):
        self.k = k
        self.score = np.full((queries, windows, k), LEAST)
        self.ids = np.full((queries, windows, k), MOST)

    def take(self, rows: np.ndarray, j: int, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Merge scores of ``rows`` (queries) with the rows ``ids`` where they fit window j."""
        floor = self.score[rows, j, -1]
        fits = fits & (score >= floor[:, None])
        if score.shape[1] > self.k and (floor == LEAST).any():
            kth = -np.partition(np.where(fits, -score, MOST), self.k - 1, axis=1)[:, self.k - 1]
            fits &= score >= np.where(kth == -MOST, LEAST, kth)[:, None]
        r, col = np.nonzero(fits)
        if not len(r):
            return
        hit = np.unique(r)
        row = np.concatenate([r, np.repeat(hit, self.k)])
        s = np.concatenate([score[r, col], self.score[rows[hit], j].ravel()])
        i = np.concatenate([ids[col], self.ids[rows[hit], j].ravel()])
        o = np.lexsort((i, ~s, row))
        row, s, i = row[o], s[o], i[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < self.k
        self.score[rows[row[top]], j, rank[top]] = s[top]
        self.ids[rows[row[top]], j, rank[top]] = i[top]


def visit(shard: dict, q: np.ndarray, qid: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> Best:
    """The k best rows of a shard for each query and score window [lo, hi] (queries x windows; empty where lo > hi).

    ``same`` asks for rows of the query's label, else for rows of others; rows of the query's own id are passed over.
    """
    at, vec, ids, labels = shard["at"], shard["vec"], shard["ids"], shard["labels"]
    qf = q.astype(np.float64)
    size = np.sqrt(np.einsum("ij,ij->i", qf, qf))[:, None]
    mean, radius = shard["mean"], shard["radius"][None, :]
    mid = qf @ mean.T
    slack = 1 + 1e-9 * size * (np.sqrt(np.einsum("ij,ij->i", mean, mean))[None, :] + radius)
    above, under = (np.clip(x, -float(MOST), float(MOST)) for x in (mid + size * radius + slack, mid - size * radius - slack))
    order = np.argsort(-above, axis=1, kind="stable")
    best, active, every = Best(len(q), lo.shape[1], k), lo <= hi, np.arange(len(q))
    for s in range(len(at) - 1):
        c = order[:, s]
        top, low = above[every, c][:, None], under[every, c][:, None]
        active &= top >= best.score[:, :, -1]  # bounds only fall from here on
        want = active & (top >= lo) & (low <= hi)
        rows = np.flatnonzero(want.any(axis=1))
        if not active.any():
            break
        for block in np.unique(c[rows]).tolist():
            own = rows[c[rows] == block]
            part = slice(at[block], at[block + 1])
            score = scores(q[own], vec[part])
            fits = ((labels[part][None, :] == label[own][:, None]) == same) & (ids[part][None, :] != qid[own][:, None])
            for j in range(lo.shape[1]):
                mine = np.flatnonzero(want[own, j])
                if len(mine):
                    sc = score[mine]
                    best.take(own[mine], j, sc, ids[part], fits[mine] & (sc >= lo[own[mine], j][:, None]) & (sc <= hi[own[mine], j][:, None]))
    return best


def usable(embedding: str) -> Column:
    e = F.col(embedding)
    return F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def fit(ws: Workspace, rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by number of components, of a sample of SAMPLE rows by the hash of their ids."""
    seen = rows.agg(F.max("dim"), F.count("*")).first()
    if not seen[1]:
        return {}
    n = int(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * seen[0]))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("dim", "vec").toArrow()
    lists = int(np.clip(seen[1] // 1024, 1, CENTROIDS))
    dims = np.array(sample.column("dim").to_pylist())
    vecs = sample.column("vec").to_pylist()
    out = {}
    for dim in np.unique(dims).tolist():
        x = np.frombuffer(b"".join(vecs[i] for i in np.flatnonzero(dims == dim)), "<i8").reshape(-1, dim).astype(np.float64)
        out[dim] = kmeans(x, max(1, lists * len(x) // len(vecs)))
    return out


def index(ws: Workspace, rows: DataFrame) -> tuple[DataFrame, int]:
    """The saved inverted lists, a row for each shard and number of components, and how many shards there are; every row of ``rows`` is in it."""
    centroids = fit(ws, rows)
    known = ws.spark.sparkContext.broadcast(centroids)  # at most CENTROIDS vectors, from a sample of SAMPLE_BYTES

    def assign(batches):
        for b in batches:
            dims, vecs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            own = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                if dim in known.value:
                    own[mine] = nearest(np.frombuffer(b"".join(vecs[i] for i in mine), "<i8").reshape(-1, dim).astype(np.float64), known.value[dim])
            yield pa.RecordBatch.from_arrays([pa.array(own + (dims.astype(np.int64) << 12)), *(b.column(c) for c in ("dim", "vec_id", "label", "vec"))], names=["list", "dim", "vec_id", "label", "vec"])

    lists = ws.save(rows.mapInArrow(assign, "list long, dim int, vec_id long, label int, vec binary"), "lists")
    room = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.expr(f"{BLOCK_BYTES} div (8 * dim)")))
    sizes, total = ws.measured(lists.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.first(room)).cast("long").alias("blocks")), "sizes", rows=F.sum("n"), blocks=F.sum("blocks"))
    shards = max(1, -(-total["blocks"] // BLOCKS))
    placed = meet(lists, sizes, "list", "n", total["rows"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("list", "block"), F.lit(shards)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("block", "ascending"), ("vec_id", "ascending"), ("label", "ascending"), ("vec", "ascending")]).combine_chunks()
        dim = table.column("dim")[0].as_py()
        x = _integers(table.column("vec"), dim)
        cols = [table.column(c).to_numpy() for c in ("list", "block", "vec_id", "label")]
        new = np.ones(len(x), bool)  # equal rows lie side by side and count once
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        x, (lists_, blocks_, ids, labels) = x[new], [c[new] for c in cols]
        cut = np.flatnonzero(np.concatenate([[True], (lists_[1:] != lists_[:-1]) | (blocks_[1:] != blocks_[:-1])]))
        at = np.append(cut, len(x))
        parts = [x[a:b].astype(np.float64) for a, b in zip(at[:-1], at[1:], strict=True)]
        mean = np.array([p.mean(axis=0) for p in parts])
        radius = np.array([np.sqrt(((p - m) ** 2).sum(axis=1).max()) * (1 + 1e-9) for p, m in zip(parts, mean, strict=True)])
        values = {"at": at.astype("<i8"), "mean": mean.astype("<f8"), "radius": radius.astype("<f8"), "ids": ids.astype("<i8"), "labels": labels.astype("<i4"), "vec": x.astype("<i8")}
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in values.items()}})

    packed = placed.groupBy("dim", "shard").applyInArrow(pack, f"dim int, shard int, {', '.join(f'{k} binary' for k in PACKED)}")
    out = ws.save(packed, "shards")
    ws.drop("lists")
    return out, shards


#: What a packed shard holds, and the kinds of the values.
PACKED = {"at": "<i8", "mean": "<f8", "radius": "<f8", "ids": "<i8", "labels": "<i4", "vec": "<i8"}


def query_blocks(queries: DataFrame, shards: int) -> DataFrame:
    """Queries (dim, vec_id, label, vec, lo, hi: arrays of the windows) in blobs of up to QUERIES, one copy for every shard."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def row(key, got):
            ids, labels, vecs, lo, hi = zip(*got, strict=True)
            blob = lambda v, kind: pa.array([np.array(v, kind).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), blob(ids, "<i8"), blob(labels, "<i4"), pa.array([b"".join(vecs)], pa.binary()), blob(lo, "<i8"), blob(hi, "<i8")], names=["dim", "windows", "qid", "qlabel", "q", "lo", "hi"])

        for b in batches:
            for r in b.to_pylist():
                key = (r["dim"], len(r["lo"]))
                got = held.setdefault(key, [])
                got.append((r["vec_id"], r["label"], r["vec"], r["lo"], r["hi"]))
                if len(got) == QUERIES:
                    yield row(key, held.pop(key))
        for key, got in held.items():
            yield row(key, got)

    blocks = queries.select("dim", "vec_id", "label", "vec", "lo", "hi").mapInArrow(run, "dim int, windows int, qid binary, qlabel binary, q binary, lo binary, hi binary")
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def search(shards: DataFrame, blocks: DataFrame, count: int, same: bool, k: int) -> DataFrame:
    """(query_id, window, rank, vec_id, score): the k best of what all shards keep for each query and window.

    Both sides are dealt by shard to a number of tasks of their own: the work is in the products, which adaptive merging by bytes does not see.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim, n = r["dim"], r["windows"]
                shard = {c: np.frombuffer(r[c], kind) for c, kind in PACKED.items()}
                shard |= {c: shard[c].reshape(-1, dim) for c in ("mean", "vec")}
                qid = np.frombuffer(r["qid"], "<i8")
                lo, hi = (np.frombuffer(r[c], "<i8").reshape(-1, n) for c in ("lo", "hi"))
                best = visit(shard, np.frombuffer(r["q"], "<i8").reshape(-1, dim), qid, np.frombuffer(r["qlabel"], "<i4"), lo, hi, same, k)
                q, j, rank = np.nonzero(best.score > LEAST)
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(j.astype(np.int32)), pa.array(best.ids[q, j, rank]), pa.array(best.score[q, j, rank])], names=["query_id", "window", "vec_id", "score"])

    parts = max(count, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = shards.repartition(parts, "dim", "shard").join(blocks.repartition(parts, "dim", "shard"), ["dim", "shard"])
    found = met.mapInArrow(run, "query_id long, window int, vec_id long, score long")
    w = Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def percent(score: Column, part: int, rounded) -> Column:
    """``part`` percent of a score, rounded to an integer by ``rounded`` (ceil or floor); exact, within 64 bits."""
    exact = rounded(score.cast("decimal(20,0)") * F.lit(part).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)"))
    return F.least(F.greatest(exact, F.lit(-int(MOST))), F.lit(int(MOST))).cast("long")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, vec: integers) that ``anchors`` selects.

    The first ``positives`` other rows of an anchor's label, and for each of them the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` percent of its score.
    """
    ws = Workspace(rows.sparkSession)
    rows = ws.save(rows, "rows")
    shards, count = index(ws, rows)
    one = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vec", "dim")).alias("r"))
    asked = ws.save(one.select("vec_id", "r.label", "r.vec", "r.dim"), "anchors")
    every = lambda x: F.array(F.lit(x))
    near = search(shards, query_blocks(asked.withColumns({"lo": every(-int(MOST)), "hi": every(int(MOST))}), count), count, True, positives)
    near = ws.save(near.select(F.col("query_id").alias("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    each = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("p"))
    each = each.select(F.col("anchor_id").alias("vec_id"), F.transform("p", lambda x: percent(x["positive_score"], low, F.ceil)).alias("lo"), F.transform("p", lambda x: percent(x["positive_score"], high, F.floor)).alias("hi"))
    far = search(shards, query_blocks(asked.join(each, "vec_id"), count), count, False, negatives)
    out = far.select(F.col("query_id").alias("anchor_id"), "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec) of the usable rows; vec holds floor(256 x) of each component as 64-bit integers, beyond these the nearest one."""
    label = F.col("label").cast("int")
    e = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    e = e.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            flat, n = b.column("v").flatten().to_numpy(zero_copy_only=False), b.column("v").value_lengths().to_numpy()
            with np.errstate(over="ignore"):
                y = np.floor(256 * flat)
            whole = np.where(np.abs(y) < 2.0**63, y, 0).astype("<i8")
            whole[y >= 2.0**63], whole[y <= -(2.0**63)] = MOST, -MOST
            at = np.append(0, np.cumsum(n)).astype(np.int64)
            vec = [whole[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(n, pa.int32()), pa.array(vec, pa.binary())], names=["vec_id", "label", "dim", "vec"])

    return e.mapInArrow(run, "vec_id long, label int, dim int, vec binary")


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Three hard negatives for each of the five positives of every row whose vec_id is divisible by 50.

    Rows without a vec_id or label, and those whose vector is null, empty or holds a null or non-finite component take no part.
    Vectors with different numbers of components are never compared. Rows equal in vec_id, label and vector count once; where
    rows of one vec_id differ, each is a candidate and the one of the smallest label, then vector, is the anchor; no row is its own id's positive or
    negative. Ties go to the smaller vec_id. Integers beyond 64 bits become the nearest one. An empty table gives no rows; extra columns are ignored.
    """
    return hard_negatives(integer_rows(embeddings), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
g AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT g.anchor_id, g.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.vec_id AS negative_id, g.score AS positive_score, p.score AS negative_score
FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 50 * g.score <= 100 * p.score AND 100 * p.score <= 95 * g.score
WINDOW w AS (PARTITION BY g.anchor_id, g.vec_id ORDER BY p.score DESC, p.vec_id)
QUALIFY row_number() OVER w <= 3
"""
