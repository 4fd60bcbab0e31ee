"""Ordered passes within groups of any size: running sums and last values seen, in two levels.

A window over a group is one task. Here the rows of large groups are cut into buckets by quantiles of the first order column; sums and last values of the
buckets are carried on over a few rows a group, and the pass itself runs within (group, bucket). Groups of up to ROWS rows are one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows from which a group is cut, and into how many buckets; rows that share the first order column stay together.
ROWS, BUCKETS = 1_000_000, 256
#: Large groups up to which their bounds are broadcast (some 2 KB each).
MOST = 20_000


def bucketed(df: DataFrame, group: str, by: Column, rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with __bucket, and whether any group is cut. There are fewer large groups than rows / ROWS."""
    least = ROWS if rows is None else rows
    large = df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(group)
    n = large.count()
    if not n:
        return df.withColumn("__bucket", F.lit(0)), False
    sent = F.broadcast if n <= MOST else (lambda x: x)
    cuts = df.select(group, by.cast("double").alias("__by")).join(sent(large), group).groupBy(group).agg(F.percentile_approx("__by", [k / BUCKETS for k in range(1, BUCKETS)], 20 * BUCKETS).alias("__cuts"))
    place = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= by.cast("double"))), F.lit(0))
    return df.join(sent(cuts), group, "left").withColumn("__bucket", F.when(F.col("__cuts").isNull(), 0).otherwise(place)).drop("__cuts"), True


def running(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with sums up to and including each row, and the last value that is not null, in the order given within each group.

    ``order`` tells rows of a group apart; its first column is a number or a time in numbers. A group of null is a group.
    """
    sums, lasts = sums or {}, lasts or {}
    columns = df.columns
    given = df.select("*", *(c.alias(f"__in_{k}") for k, c in (sums | lasts).items()), *(c.alias(f"__o{i}") for i, c in enumerate(order)))
    by = [F.col(f"__o{i}") for i in range(len(order))]
    placed, cut = bucketed(given, group, by[0], rows)
    local = Window.partitionBy(group, "__bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    own = {k: F.sum(f"__in_{k}").over(local) for k in sums} | {k: F.last(f"__in_{k}", True).over(local) for k in lasts}
    if not cut:
        return placed.select(*columns, *(c.alias(k) for k, c in own.items()))
    latest = lambda k: F.max(F.when(F.col(f"__in_{k}").isNotNull(), F.struct(*by, F.col(f"__in_{k}").alias("v"))))["v"]
    parts = placed.groupBy(group, "__bucket").agg(*(F.sum(f"__in_{k}").alias(f"__c_{k}") for k in sums), *(latest(k).alias(f"__c_{k}") for k in lasts))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(group, "__bucket", *(F.sum(f"__c_{k}").over(before).alias(f"__b_{k}") for k in sums), *(F.last(f"__c_{k}", True).over(before).alias(f"__b_{k}") for k in lasts))
    carried = carried.where("__bucket > 0")  # of large groups alone
    joined = placed.join(F.broadcast(carried) if carried.limit(MOST + 1).count() <= MOST else carried, [group, "__bucket"], "left")
    out = {k: c + F.coalesce(F.col(f"__b_{k}"), F.lit(0)) for k, c in own.items() if k in sums} | {k: F.coalesce(c, f"__b_{k}") for k, c in own.items() if k in lasts}
    return joined.select(*columns, *(c.alias(k) for k, c in out.items()))
