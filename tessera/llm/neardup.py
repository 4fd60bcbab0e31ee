"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are put in the order of a row of random hashes (signs of random projections,
concatenated), which brings near vectors close to each other, and each is compared with the WINDOW that follow it.
Pairs that are near enough are united, over all passes, to components. The number of passes follows from the
number of vectors. Inside a component all links are then counted exactly, whatever the windows have
seen: vectors near enough to their component's mean are linked with one another by the triangle inequality on angles and are
only counted; what remains is compared in tiles of bounded size. No pair of a group becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ann import usable
from .components import components, meet
from .store import Workspace

COSINE = 0.95
#: Vectors that each is compared with after its place in a pass, hashes of a pass, places of a block, and vectors of a tile.
WINDOW, HASHES, BLOCK, TILE = 64, 60, 2_048, 4_096
#: Share of pairs at the threshold that all passes may miss, by which their number is chosen; at least LEAST passes.
MISS, LEAST = 0.01, 6


def passes(n: int, cosine: float) -> int:
    """Passes after which a pair at the threshold has shared a window but for a chance of MISS.

    Two vectors stand within a window if they share the first hashes, as many as cut n vectors into windows; each hash is shared with a chance of 1 - angle / pi.
    """
    bits = np.log2(max(n / WINDOW, 1)) + 1
    p = (1 - np.arccos(cosine) / np.pi) ** bits
    return max(LEAST, int(np.ceil(np.log(MISS) / np.log1p(-p))))


def units(vec: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, from the bytes of 32- or 64-bit floats; scaled first, so that no magnitude overflows."""
    kind = "<f4" if len(vec[0]) == 4 * dim else "<f8"
    v = np.frombuffer(b"".join(vec), kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, k, vec) of the usable rows: the vector's bytes, in the precision of the column, and their digest."""
    kind = "<f4" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "<f8"
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable("embedding"))

    def run(batches):
        for b in batches:
            flat, n = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0), b.column(1).value_lengths().to_numpy()
            at = np.append(0, np.cumsum(n)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["vec_id", "dim", "vec"])

    return e.mapInArrow(run, "vec_id long, dim int, vec binary").withColumn("k", F.unhex(F.md5("vec")))


def pass_keys(nodes: DataFrame, rounds: int, seed: int = 13) -> DataFrame:
    """(node, pass, dim, key): the concatenated hashes of each vector in each pass."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims, vecs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            keys = np.zeros((len(dims), rounds), np.int64)
            for dim, mine in by_dim(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, rounds * HASHES)).astype(np.float32)
                for part in np.array_split(mine, max(1, len(mine) // 256)):
                    signs = (units([vecs[i] for i in part], dim).astype(np.float32) @ planes[dim] > 0).reshape(len(part), rounds, HASHES)
                    keys[part] = signs @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))
            flat = pa.array(keys.ravel())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("dim"), pa.FixedSizeListArray.from_arrays(flat, rounds).cast(pa.list_(pa.int64()))], names=["node", "dim", "keys"])

    out = nodes.select("node", "dim", "vec").mapInArrow(run, "node long, dim int, keys array<long>")
    return out.select("node", "dim", F.posexplode("keys").alias("pass", "key"))


def windows_united(u: np.ndarray, cosine: float) -> np.ndarray:
    """For each vector the first of those that it is united with, where pairs at most WINDOW places apart are compared."""
    n, step = len(u), 2 * WINDOW
    a, b = [], []
    for i in range(0, n, step):
        near = u[i : i + step] @ u[i : i + step + WINDOW].T >= cosine
        r, c = np.nonzero(near)
        ok = (c > r) & (c <= r + WINDOW)
        a.append(r[ok] + i)
        b.append(c[ok] + i)
    a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def candidate_links(ws: Workspace, nodes: DataFrame, count: int, cosine: float) -> DataFrame:
    """(a, b): pairs of nodes that are united; a block sends one for each of its vectors at most."""
    rounds = passes(count, cosine)
    parts = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), count * rounds // 1_000_000)
    order = pass_keys(nodes, rounds).repartitionByRange(parts, "pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node")
    order = ws.save(order.select("node", F.monotonically_increasing_id().alias("at")), "order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each range
    places = order.withColumn("part", part).join(F.broadcast(base), "part").select("node", (F.col("base") + place).alias("p"))
    placed = places.groupBy("node").agg(F.collect_list("p").alias("ps")).join(nodes.select("node", "dim", "vec"), "node")

    def seen(p: Column) -> Column:
        own = F.struct(p.alias("p"), (p - F.pmod(p, F.lit(BLOCK))).alias("block"))
        guest = F.struct(p.alias("p"), (p - F.pmod(p, F.lit(BLOCK)) - BLOCK).alias("block"))  # the block before compares its last ones with it
        return F.when((F.pmod(p, F.lit(BLOCK)) < WINDOW) & (p >= BLOCK), F.array(own, guest)).otherwise(F.array(own))

    dealt = placed.select("node", "dim", "vec", F.inline(F.flatten(F.transform("ps", seen))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("p").combine_chunks()
        node, vecs, a, b = table.column("node").to_numpy(), table.column("vec").to_pylist(), [], []
        for dim, mine in by_dim(table.column("dim").to_numpy()):
            label = windows_united(units([vecs[i] for i in mine], dim), cosine)
            other = np.flatnonzero(label != np.arange(len(mine)))
            a.append(node[mine[label[other]]])
            b.append(node[mine[other]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    links = ws.save(dealt.groupBy("block").applyInArrow(run, "a long, b long"), "links")
    ws.drop("order")
    return links


def count_pairs(u: np.ndarray, w: np.ndarray, cosine: float, v: np.ndarray | None = None, x: np.ndarray | None = None, y: np.ndarray | None = None, vw: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked with each of u, and with each of v (u itself if left out); nodes x and y that are the same do not count."""
    v, vw = (u, w) if v is None else (v, vw)
    left, right = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
    for i in range(0, len(u), 512):
        near = u[i : i + 512] @ v.T >= cosine
        if x is None:
            r = np.arange(min(512, len(u) - i))
            near[r, r + i] = False
        else:
            near &= x[i : i + 512, None] != y[None, :]
        left[i : i + 512] = near @ vw
        right += w[i : i + 512] @ near
    return left, right


def count_links(ws: Workspace, nodes: DataFrame, of: DataFrame, rows: int, cosine: float, tile: int) -> DataFrame:
    """(node, n_links) of every node that has a component (``of``: node, component; ``rows`` of them): rows linked directly, its own copies included."""
    sizes = ws.save(of.groupBy("component").agg(F.count("*").alias("m")), "sizes")
    sizes = sizes.select("component", "m", F.col("m").alias("size"))
    members = meet(of.join(nodes.select("node", "n", "dim", "vec"), "node"), sizes, "component", "m", rows)
    members = ws.save(members, "members")
    small, large = members.where(F.col("size") <= tile), members.where(F.col("size") > tile)

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("component").combine_chunks()
        comp, n, dim, vecs = table.column("component").to_numpy(), table.column("n").to_numpy(), table.column("dim").to_numpy(), table.column("vec").to_pylist()
        links = n - 1
        at = np.append(np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]])), len(comp)).tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            links[i:j] += count_pairs(units(vecs[i:j], int(dim[i])), n[i:j], cosine)[0]
        return pa.table({"node": table.column("node"), "n_links": links})

    bins = F.pmod(F.xxhash64("component"), F.lit(max(1, rows // tile)))
    counted = small.withColumn("bin", bins).groupBy("bin").applyInArrow(whole, "node long, n_links long")
    if not large.limit(1).count():
        return ws.save(counted, "counted")
    return ws.save(counted.unionAll(_large(ws, large, rows, cosine, tile)), "counted")


def _large(ws: Workspace, large: DataFrame, rows: int, cosine: float, tile: int) -> DataFrame:
    """(node, n_links) for components of more than a tile."""

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            comp, dims, vecs = b.column("component").to_numpy(), b.column("dim").to_numpy(), b.column("vec").to_pylist()
            for c in np.unique(comp).tolist():
                mine = np.flatnonzero(comp == c)
                held[c] = held.get(c, 0) + units([vecs[i] for i in mine], int(dims[mine[0]])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], names=["component", "center"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<f8") for x in table.column("center").to_pylist()]
        total = np.sum(parts, axis=0)
        return pa.table({"component": table.column("component")[:1], "center": pa.array([total.tobytes()], pa.binary())})

    centers = large.select("component", "dim", "vec").mapInArrow(sums, "component long, center binary").groupBy("component").applyInArrow(add, "component long, center binary")
    centers = ws.save(centers.join(large.select("component", F.col("size").alias("m")).distinct(), "component"), "centers")

    def angles(batches):
        for b in batches:
            comp, dims, vecs, mids = b.column("component").to_numpy(), b.column("dim").to_numpy(), b.column("vec").to_pylist(), b.column("center").to_pylist()
            core = np.zeros(len(comp), bool)
            for c in np.unique(comp).tolist():
                mine = np.flatnonzero(comp == c)
                mid = np.frombuffer(mids[mine[0]], "<f8")
                if size := np.sqrt(mid @ mid):
                    turn = np.arccos(np.clip(units([vecs[i] for i in mine], int(dims[mine[0]])) @ (mid / size), -1, 1))
                    core[mine] = turn <= np.arccos(cosine) / 2 - 1e-6
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "node", "n", "dim", "vec", "size")), pa.array(core)], names=["component", "node", "n", "dim", "vec", "size", "core"])

    turned = ws.save(meet(large, centers, "component", "m", rows).mapInArrow(angles, "component long, node long, n long, dim int, vec binary, size long, core boolean"), "turned")
    stats = turned.groupBy("component").agg(F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("weight"), F.count_if(~F.col("core")).alias("outer"), F.count("*").alias("m"))
    known = meet(turned, ws.save(stats, "stats"), "component", "m", rows)
    base = known.select("node", F.when(F.col("core"), F.col("weight") - 1).otherwise(F.col("n") - 1).alias("n_links"))
    some = known.where("outer > 0")
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / tile)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), tiles(c)).cast("int")
    slim = ["component", "node", "n", "dim", "vec", "core"]
    left = some.where(~F.col("core")).select(*slim, F.lit(True).alias("asks"), own("outer").alias("i"), F.explode(F.sequence(F.lit(0), tiles("size") - 1)).alias("j"))
    right = some.select(*slim, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), tiles("outer") - 1)).alias("i"), own("size").alias("j"))

    def cell(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        node, n, core = table.column("node").to_numpy(), table.column("n").to_numpy(), np.array(table.column("core").to_pylist(), bool)
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(x) or not len(y):
            return pa.table({"node": np.zeros(0, np.int64), "n_links": np.zeros(0, np.int64)})
        u = units(table.column("vec").to_pylist(), table.column("dim")[0].as_py())
        of_x, of_y = count_pairs(u[x], n[x], cosine, u[y], node[x], node[y], n[y])
        inner = core[y]  # others ask for themselves
        return pa.table({"node": np.concatenate([node[x], node[y[inner]]]), "n_links": np.concatenate([of_x, of_y[inner]])})

    compared = left.unionAll(right).groupBy("component", "i", "j").applyInArrow(cell, "node long, n_links long")
    return base.unionAll(compared).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    ws = Workspace(embeddings.sparkSession)
    found = vectors(embeddings)
    nodes = found.groupBy("k").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes, size = ws.measured(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", count=F.count(F.lit(1)), rows=F.sum("n"))
    links = candidate_links(ws, nodes, size["count"], cosine)
    of, held = ws.measured(components(ws, links, "a", "b"), "components", rows=F.count(F.lit(1)))
    counted = count_links(ws, nodes, of, held["rows"], cosine, tile)
    least = of.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    named = meet(of, ws.save(least, "least"), "component", "m", held["rows"]).select("node", F.lit(True).alias("grouped"), "component_id").join(counted, "node")
    result = nodes.select("node", "k", "n", "first").join(named, "node", "left").select(
        "k", "n", F.coalesce("n_links", F.col("n") - 1).alias("n_links"), F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    joined = meet(found.select("vec_id", "k"), ws.save(result, "result"), "k", "n", size["rows"]).select("vec_id", "n_links", "component_id")
    rest = embeddings.where(~usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return joined.unionAll(rest)


def op13_near_duplicates(embeddings: DataFrame) -> DataFrame:
    """Direct links, component and verdict of every row at a cosine of 0.95.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors with different numbers of components.
    Equal vectors are linked with each other; a repeated row is another row. Rows without a vec_id are linked but name no component: it is null
    where a group has no other. An empty table gives no rows; extra columns are ignored. Links are counted exactly within a component; two components
    whose pairs share no window in any pass stay apart. Equal vectors are told by a 128-bit digest.
    """
    return near_duplicates(embeddings).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, least(vec_id, coalesce(y, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
