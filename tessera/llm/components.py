"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Rows under one key from which it is a hub, and the most hubs that are broadcast.
HUB, MOST_HUBS = 256, 500_000


def meet(many: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key and, in ``size``, the number of rows that ``many`` has under it.

    ``total`` is the number of rows of ``many``. Keys of more than total / MOST_HUBS rows (or HUB, if that is more) meet their row
    by broadcast: there are fewer than MOST_HUBS of them, whatever the data. All other keys meet in a shuffle, where none is hot.
    """
    if total <= HUB:
        return many.join(one.drop(size), key)
    least = max(HUB, total // MOST_HUBS)
    hubs = F.broadcast(one.where(F.col(size) > least).drop(size))
    rest = many.join(hubs.select(key), key, "left_anti").join(one.where(F.col(size) <= least).drop(size), key)
    return many.join(hubs, key).unionByName(rest)


def components(ws: Workspace, edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reached.

    Each round is written to the shared folder, so a lost executor costs one round. Rounds
    go on until the stars no longer change (logarithmic in the number of nodes). Null ends
    and self links are ignored; repeated links count once. A hub's edges stay where they are:
    its least neighbour is summed up before the shuffle and broadcast to them.
    """
    hi, lo, n = F.col("hi"), F.col("lo"), F.col("n")
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (hi != lo)
    )
    stars = {"rows": F.count(F.lit(1)), "sum": F.bit_xor(F.xxhash64("hi", "lo"))}
    (e, state), step, seen = ws.measured(e.distinct(), f"{name}-0", **stars), 0, None
    while state["rows"] and state != seen:
        seen = state
        step += 1
        both = e.select(hi.alias("u"), lo.alias("v")).unionAll(e.select(lo.alias("u"), hi.alias("v")))
        least, size = ws.measured(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"{name}-least-{step}", most=F.max(n))
        hubs = size["most"] > HUB
        large = meet(both, least, "u", "n", 2 * state["rows"]) if hubs else both.join(least.drop("n"), "u")
        large = large.where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        if hubs:
            large, size = ws.measured(large, f"{name}-large-{step}", rows=F.count(F.lit(1)))
        small = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        joined = meet(large, ws.save(small, f"{name}-small-{step}"), "hi", "n", size["rows"]) if hubs else large.join(small.drop("n"), "hi")
        out = joined.where(lo != F.col("m")).select(lo.alias("hi"), F.col("m").alias("lo")).unionAll(small.select("hi", F.col("m").alias("lo")))
        e, state = ws.measured(out.distinct(), f"{name}-{step}", **stars)
        for old in (f"{name}-{step - 1}", f"{name}-least-{step}", f"{name}-large-{step}", f"{name}-small-{step}"):
            ws.drop(old)
    return e.select(hi.alias("node"), lo.alias("component")).unionAll(e.select(lo.alias("node"), lo.alias("component")).distinct())
