"""Decoding by plane against decoding by stream, and verification in one pass against the decoders' rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import media
from tessera.plans import media as plans
from tests.conftest import SF


@pytest.fixture(scope="module")
def packets(spark):
    """Packets of the clips, and copies of them with payloads broken at every layer, a wrong size, repeated ids and missing references."""
    found, streams = plans.encoded_packets(spark, SF)
    rows, rnd = [tuple(r) for r in found.collect()], random.Random(4)
    columns = found.columns
    f, k, p = columns.index("file_id"), columns.index("kind"), columns.index("payload")
    out = list(rows)
    for copy in range(24):
        for r in rows:
            r, b = list(r), bytearray(r[p])
            r[f] = f"{r[f]}-{copy}"
            roll = rnd.random()
            if r[k] == "video_frame" and roll < 0.25:
                at = rnd.randrange(40) if roll < 0.08 else rnd.randrange(len(b))
                b[min(at, len(b) - 1)] ^= 1 << rnd.randrange(8)
            elif roll < 0.3:
                b = b[: rnd.randrange(len(b) + 1)]
            r[p] = bytes(b)
            out.append(tuple(r))
    df = spark.createDataFrame(out, found.schema).withColumn("byte_offset", F.lit(0).cast("long"))
    files = df.select("file_id").distinct()
    rows = [(s.id, "video" if s.kind == 1 else "audio", s.codec, s.param0, s.param1) for s in streams]
    described = files.crossJoin(F.broadcast(spark.createDataFrame(rows, "stream_id int, kind string, codec int, param0 long, param1 long")))
    wrong = F.when((F.col("kind") == "video") & F.col("file_id").endswith("-3"), F.lit(24)).otherwise(F.col("param0"))
    return df, described.withColumn("param0", wrong.cast("long"))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_planes_equal_streams(packets):
    routed = media.route(*packets).persist()
    whole, planes = media.decode_video(routed), media.decode_video_by_plane(routed)
    assert planes.columns == whole.columns
    want = rows(whole)
    assert rows(planes) == want
    assert len({r.error_code for r in whole.select("error_code").distinct().collect()}) >= 8
    assert whole.where("error_code IS NULL").count() > 300


def test_verify_counts_what_the_decoders_give(packets):
    r = media.route(*packets)
    parts = [
        media.decode_video(r).select("file_id", F.lit("video").alias("kind"), "stream_id", "error_code"),
        media.decode_audio(r).select("file_id", F.lit("audio").alias("kind"), "stream_id", "error_code"),
        r.where("error_code IS NOT NULL").select("file_id", F.lit("rejected").alias("kind"), "stream_id", "error_code"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = every.groupBy("file_id", "kind", "stream_id").agg(F.count_if(F.col("error_code").isNull()).alias("n"), F.count_if(F.col("error_code").isNotNull()).alias("rejected"))
    got = media.verify(*packets)
    assert rows(got) == rows(want)
    plan = media.verify(*packets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
