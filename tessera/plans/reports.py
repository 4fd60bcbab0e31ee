"""Queries over reports and artifacts: digests, escaped text, metric tables in CSV and JSON files, displacement grids, PCM bytes, packet sizes of audio settings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import media

from .carriers import blocks, read, sql_blocks
from .media import shared

#: How a JSON string writes the characters that it cannot hold: short forms, then the other control characters by number.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(1, 32) if chr(c) not in ESCAPES}


def json_escaped(text: Column) -> Column:
    """The inside of a JSON string; the backslash comes first, so that none is written twice."""
    return functools.reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), text)


def json_escape(spark, sf):
    """Texts of conversations with every control character once somewhere, escaped; and whether a JSON reader gives them back."""
    t = read(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit('"\\/'), F.chr(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(31)) + 1), F.lit("é")).alias("t"))
    e = t.select("conv_id", "turn", "t", json_escaped(F.col("t")).alias("escaped"))
    back = F.get_json_object(F.concat(F.lit('{"s":"'), "escaped", F.lit('"}')), "$.s")
    return e.select("conv_id", "turn", F.md5("escaped").alias("digest"), (back == F.col("t")).alias("exact"))


_ESCAPED = functools.reduce(lambda x, e: f"replace({x}, chr({ord(e[0])}), '{e[1]}')", ESCAPES.items(), "t")
JSON_ESCAPE = f"""WITH c AS (SELECT conv_id, turn, text || '"\\/' || chr(CAST((conv_id + turn) % 31 + 1 AS INTEGER)) || 'é' AS t FROM conversations)
SELECT conv_id, turn, md5({_ESCAPED}) AS digest, true AS exact FROM c"""


def artifact_digests(spark, sf):
    """SHA-256 and size of every text's bytes."""
    b = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("bigint").alias("bytes"))


ARTIFACT_DIGESTS = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents"


def _metrics(spark, sf) -> DataFrame:
    e = read(spark, sf, "lineitem")
    return e.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("points"), F.round(F.avg("l_quantity"), 6).alias("mean_bytes"))


def metric_files(spark, sf):
    """A table of metrics written as CSV with a header and as JSON lines, and read back from both."""
    root, m = shared(spark), _metrics(spark, sf)
    m.write.option("header", True).csv(f"{root}/csv")
    m.write.json(f"{root}/json")
    csv = spark.read.schema(m.schema).option("header", True).csv(f"{root}/csv").withColumn("format", F.lit("csv"))
    return csv.unionByName(spark.read.schema(m.schema).json(f"{root}/json").withColumn("format", F.lit("json")))


METRIC_FILES = """WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS points, round(avg(l_quantity), 6) AS mean_bytes FROM lineitem GROUP BY ALL)
SELECT *, 'csv' AS format FROM m UNION ALL SELECT *, 'json' FROM m"""


def motion_grid(spark, sf):
    """Each 8x8 block against the block before it, moved by up to two samples either way, edges repeated: the least sum of absolute
    differences; among equals no motion, then rows, then columns."""
    w = Window.partitionBy("label").orderBy("vec_id")
    b = blocks(spark, sf, 255).select("vec_id", "x", F.lag("x").over(w).alias("ref")).where("ref IS NOT NULL")
    one = lambda c: F.explode(F.sequence(F.lit(-2), F.lit(2))).alias(c)
    grid = spark.range(1).select(one("dy")).select("dy", one("dx"))
    place = lambda i: F.least(F.greatest(F.floor(i / 8) + F.col("dy"), F.lit(0)), F.lit(7)) * 8 + F.least(F.greatest(i % 8 + F.col("dx"), F.lit(0)), F.lit(7))
    diff = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.abs(F.get("x", i) - F.get("ref", place(i).cast("int"))))
    c = b.crossJoin(F.broadcast(grid))  # 25 displacements
    c = c.select("vec_id", F.struct(F.aggregate(diff, F.lit(0).cast("bigint"), lambda s, d: s + d).alias("sad"), ((F.col("dx") != 0) | (F.col("dy") != 0)).alias("moved"), "dy", "dx").alias("k"))
    return c.groupBy("vec_id").agg(F.min("k").alias("k")).select("vec_id", "k.sad", F.col("k.dx").cast("bigint").alias("dx"), F.col("k.dy").cast("bigint").alias("dy"))


MOTION_GRID = f"""WITH {sql_blocks(255)}, r AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM blocks),
g AS (SELECT dx, dy FROM generate_series(-2, 2) a(dx), generate_series(-2, 2) b(dy)),
s AS (SELECT vec_id, dx, dy, CAST(list_sum(list_transform(generate_series(0, 63), lambda i: abs(x[i + 1] - y[least(greatest(i // 8 + dy, 0), 7) * 8 + least(greatest(i % 8 + dx, 0), 7) + 1]))) AS BIGINT) AS sad FROM r, g WHERE y IS NOT NULL)
SELECT vec_id, sad, dx, dy FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sad, dx <> 0 OR dy <> 0, dy, dx) = 1"""


def pcm_s16le(spark, sf):
    """Blocks as PCM packets of 64 samples: their bytes, little-endian, in hexadecimal."""
    sample = lambda v: F.least(F.greatest(v, F.lit(-32768)), F.lit(32767)).cast("short")
    p = blocks(spark, sf).select(F.lit("a").alias("file_id"), F.col("label").cast("int").alias("stream_id"), F.col("vec_id").alias("pts"), F.transform("x", sample).alias("samples"))
    return media.pcm_bytes(p).select("stream_id", "pts", F.lower(F.hex("s16le")).alias("s16le"))


_BYTES = "format('{:02x}{:02x}', (least(greatest(v, -32768), 32767) + 65536) % 256, (least(greatest(v, -32768), 32767) + 65536) // 256 % 256)"
PCM_S16LE = f"WITH {sql_blocks()} SELECT CAST(label AS INTEGER) AS stream_id, vec_id AS pts, array_to_string(list_transform(x, lambda v: {_BYTES}), '') AS s16le FROM blocks"

_ALL = (json_escape, artifact_digests, metric_files, motion_grid, pcm_s16le)
QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in _ALL}
