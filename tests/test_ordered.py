"""Two-level passes against windows over whole groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import ordered
from tessera.plans import packets as plans
from tests.conftest import SF


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    data = [(g, rnd.choice([rnd.randrange(50), rnd.randrange(10**6), 7]), i, rnd.choice([None, None, i])) for g, n in (("hot", 6000), ("b", 400), ("c", 3), (None, 90)) for i in range(n)]
    return spark.createDataFrame(data, "g string, pts long, seq long, v long").repartition(5)


@pytest.mark.parametrize("least", [50, 1000, 10**6])
def test_running_equals_windows(table, least):
    w = Window.partitionBy("g").orderBy("pts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = table.select("g", "pts", "seq", "v", F.sum(F.lit(1)).over(w), F.sum("seq").over(w), F.last("v", True).over(w))
    got = ordered.running(table.where("g IS NOT NULL"), "g", [F.col("pts"), F.col("seq")], {"n": F.lit(1), "s": F.col("seq")}, {"l": F.col("v")}, least)
    assert rows(got) == rows(want.where("g IS NOT NULL"))


def test_a_large_group_is_many_tasks(table):
    placed, cut = ordered.bucketed(table, "g", F.col("seq"), 1000)
    sizes = {(r.g, r["__bucket"]): r["count"] for r in placed.groupBy("g", "__bucket").count().collect()}
    assert cut and len([k for k in sizes if k[0] == "hot"]) > 200 and max(n for (g, _), n in sizes.items() if g == "hot") < 100
    assert [k for k in sizes if k[0] == "b"] == [("b", 0)]


@pytest.mark.parametrize("name", ["packet_interleave", "front_offsets", "seek_epoch", "reindex_groups", "audio_to_epoch"])
def test_queries_with_cut_groups(spark, monkeypatch, name):
    query = getattr(plans, name)
    want = rows(query(spark, SF))
    monkeypatch.setattr(ordered, "ROWS", 5)
    assert rows(query(spark, SF)) == want


def test_median_by_rank(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(g, rnd.choice([None, rnd.random(), 0.5])) for g in range(40) for _ in range(rnd.randint(1, 30))], "g int, x double")
    got = plans.median_by_rank(df, "g", "x")
    assert rows(got) == rows(df.where("x IS NOT NULL").groupBy("g").agg(F.median("x")))
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
