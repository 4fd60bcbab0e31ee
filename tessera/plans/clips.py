"""Test clips whose samples are the values of the table embeddings, in Spark and in SQL.

500 vectors make six clips of 48x32, one of each pattern. Of each 500, 24 vectors of 64 components after the other are the 1536 samples of a
plane of material; the patterns show this material: cut, moved, as flat areas, as a gradient, changing with every frame, or in the chroma.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .carriers import read

PATTERNS = ("cut", "pan", "ui", "gradient", "noise", "chroma")
WIDTH, HEIGHT, FRAMES = 48, 32, 12
#: Vectors of a set of clips, and of a plane of material; planes of a set.
SET, ROWS, PLANES = 500, 24, 20
AREA = WIDTH * HEIGHT


def material(spark: SparkSession, sf: str) -> DataFrame:
    """(copy, ps): the planes of material of every set, as arrays of samples; 128 where there is no value."""
    at = F.pmod("vec_id", F.lit(SET))
    value = lambda x: F.when(F.isnan(x), 128).otherwise(F.least(F.greatest(F.floor(128 + 256 * x), F.lit(0)), F.lit(255))).cast("int")
    e = F.col("embedding").cast("array<double>")
    row = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.coalesce(value(F.get(e, j)), F.lit(128)))
    rows = read(spark, sf, "embeddings").where("vec_id IS NOT NULL").select(F.floor(F.col("vec_id") / SET).alias("copy"), F.floor(at / ROWS).cast("int").alias("k"), (at % ROWS).cast("int").alias("r"), row.alias("v"))
    rows = rows.groupBy("copy", "k", "r").agg(F.min("v").alias("v"))
    one = rows.groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") * ROWS + F.col("r")).alias("at"), "v"))).alias("m"))  # at most SET rows
    plane = lambda k: F.flatten(F.transform(F.sequence(k * ROWS, k * ROWS + ROWS - 1), lambda r: F.coalesce(F.element_at("m", r), F.array_repeat(F.lit(128), 64))))
    return one.select("copy", F.transform(F.sequence(F.lit(0), F.lit(PLANES - 1)), plane).alias("ps"))


def clips(spark: SparkSession, sf: str, frames: int = FRAMES) -> DataFrame:
    """The clips, one row a frame; each plane is one expression over its positions."""
    t, pattern, ps = F.col("frame_index"), F.col("pattern"), F.col("ps")
    at = lambda k, i: F.get(F.get(ps, F.lit(k) if isinstance(k, int) else k), i.cast("int"))

    def luma(i: Column) -> Column:
        x, y = i % WIDTH, F.floor(i / WIDTH).cast("int")
        kinds: dict[str, Column] = {
            "cut": F.when(t < FRAMES // 2, at(0, i)).otherwise(at(1, i)),
            "pan": at(2, y * WIDTH + (x + 2 * t) % WIDTH),
            "ui": F.when(x == t, 30).when(at(3, (y - y % 16) * WIDTH + x - x % 16) > 128, 220).otherwise(90),
            "gradient": (F.floor(x * 255 / WIDTH) + y * 2 + at(4, t)) % 256,
            "noise": at((5 + t).cast("int"), i),
            "chroma": at(17, F.lit(0)),
        }
        out = F.lit(0)
        for name, v in kinds.items():
            out = F.when(pattern == name, v).otherwise(out)
        return out

    def chroma(second: int) -> Callable[[Column], Column]:
        def of(i: Column) -> Column:
            j = F.floor(i / (WIDTH // 2)).cast("int") * 2 * WIDTH + i % (WIDTH // 2) * 2
            own = at(18 + second, (j + (5 if second else 3) * t) % AREA)
            return F.when(pattern == "chroma", own).otherwise(255 - luma(j + WIDTH) if second else luma(j))

        return of

    packed = lambda n, f: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(f(i).cast("long")), 2, "0")), ""))
    each = material(spark, sf).select("copy", "ps", F.explode(F.array(*map(F.lit, PATTERNS))).alias("pattern")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame_index"))
    each = each.repartition(spark.sparkContext.defaultParallelism, "copy", "pattern", "frame_index")
    return each.select(
        F.when(F.col("copy") == 0, pattern).otherwise(F.concat_ws("-", "pattern", "copy")).alias("clip_id"), "frame_index", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(24).alias("fps_n"), F.lit(1).alias("fps_d"), F.lit(0).cast("long").alias("meta0"),
        packed(AREA, luma).alias("y"), packed(AREA // 4, chroma(0)).alias("u"), packed(AREA // 4, chroma(1)).alias("v"), F.lit(None).cast("string").alias("error_code"),
    )


def _sql_luma(i: str) -> str:
    at = lambda k, j: f"ps[{k}][1 + ({j})]"
    x, y = f"(({i}) % {WIDTH})", f"(({i}) // {WIDTH})"
    return f"""CASE pattern WHEN 'cut' THEN CASE WHEN t < {FRAMES // 2} THEN {at(1, i)} ELSE {at(2, i)} END
    WHEN 'pan' THEN {at(3, f"{y} * {WIDTH} + ({x} + 2 * t) % {WIDTH}")}
    WHEN 'ui' THEN CASE WHEN {x} = t THEN 30 WHEN {at(4, f"({y} - {y} % 16) * {WIDTH} + {x} - {x} % 16")} > 128 THEN 220 ELSE 90 END
    WHEN 'gradient' THEN ({x} * 255 // {WIDTH} + {y} * 2 + {at(5, "t")}) % 256
    WHEN 'noise' THEN {at("6 + t", i)} ELSE {at(18, "0")} END"""


_J = f"(i // {WIDTH // 2} * {2 * WIDTH} + i % {WIDTH // 2} * 2)"
#: Common table expressions: luma (clip_id, t, i, y) and chroma (clip_id, t, i, u, v) of the clips.
SQL = f"""
rows_ AS (SELECT vec_id // {SET} AS copy, vec_id % {SET} AS pos, min(list_transform(range(64), lambda j: coalesce(CASE WHEN isnan(CAST(embedding[j + 1] AS DOUBLE)) THEN 128 ELSE CAST(least(greatest(floor(128 + 256 * CAST(embedding[j + 1] AS DOUBLE)), 0), 255) AS INTEGER) END, 128))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL GROUP BY ALL),
full_ AS (SELECT c.copy, g.pos, coalesce(v, list_transform(range(64), lambda j: 128)) AS v FROM (SELECT DISTINCT copy FROM rows_) c CROSS JOIN (SELECT unnest(range({PLANES * ROWS})) AS pos) g LEFT JOIN rows_ r ON r.copy = c.copy AND r.pos = g.pos),
planes_ AS (SELECT copy, pos // {ROWS} AS k, flatten(list(v ORDER BY pos)) AS p FROM full_ GROUP BY ALL),
sets_ AS (SELECT copy, list(p ORDER BY k) AS ps FROM planes_ GROUP BY copy),
frames_ AS (SELECT ps, pattern, t, CASE copy WHEN 0 THEN pattern ELSE pattern || '-' || copy END AS clip_id FROM sets_ CROSS JOIN (SELECT unnest({list(PATTERNS)}) AS pattern) CROSS JOIN (SELECT unnest(range({FRAMES})) AS t)),
luma_ AS (SELECT clip_id, t, i, CAST({_sql_luma("i")} AS BIGINT) AS y FROM frames_ CROSS JOIN (SELECT unnest(range({AREA})) AS i)),
chroma_ AS (SELECT clip_id, t, i, CAST(CASE pattern WHEN 'chroma' THEN ps[19][1 + ({_J} + 3 * t) % {AREA}] ELSE {_sql_luma(_J)} END AS BIGINT) AS u,
  CAST(CASE pattern WHEN 'chroma' THEN ps[20][1 + ({_J} + 5 * t) % {AREA}] ELSE 255 - ({_sql_luma(f"({_J} + {WIDTH})")}) END AS BIGINT) AS v FROM frames_ CROSS JOIN (SELECT unnest(range({AREA // 4})) AS i))"""
