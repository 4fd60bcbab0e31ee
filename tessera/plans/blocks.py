"""Queries over sample blocks: quantisers, transforms, tokens, distances, palettes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.functions.arrays import indexes, squares, total

from .carriers import blocks, read, sql_blocks

Q = 48
_DIV = "CASE WHEN i < 4 THEN {q} WHEN i < 16 THEN 2 * {q} ELSE 3 * {q} END"


def _round_sql(v: str, d: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN ({v} + {d} // 2) // {d} ELSE -((-({v}) + {d} // 2) // {d}) END)"


def _each(expr: str, x: str = "x") -> str:
    """DuckDB list over the positions 0..63 of a list; ``expr`` uses v and i."""
    return f"list_transform(generate_series(0, 63), lambda i: {expr.replace('v', f'{x}[i + 1]')})"


_AUDIO_Q = _each(_round_sql("v", f"({_DIV.format(q=Q)})"))


def div_round(spark, sf):
    v = F.col("l_partkey") - F.col("l_suppkey") * 7
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.div_round(v, F.col("l_linenumber") + 1).alias("rounded"), S.clip8(v).alias("clipped"))


DIV_ROUND = f"""SELECT l_orderkey, l_linenumber, CAST({_round_sql("(l_partkey - l_suppkey * 7)", "(l_linenumber + 1)")} AS BIGINT) AS rounded,
  CAST(least(greatest(l_partkey - l_suppkey * 7, 0), 255) AS BIGINT) AS clipped FROM lineitem"""


def quantize_audio(spark, sf):
    q = S.quantize_audio(F.col("x"), Q)
    d = S.dequantize_audio(F.col("q"), Q)
    return blocks(spark, sf).select("vec_id", "x", q.alias("q")).select("vec_id", total("q").alias("sum_q"), S.sse(F.col("x"), d).alias("sse"), F.size(F.filter("q", lambda v: v != 0)).cast("bigint").alias("nonzero"))


QUANTIZE_AUDIO = f"""WITH {sql_blocks()}, c AS (SELECT vec_id, x, {_AUDIO_Q} AS q FROM blocks)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS sum_q, CAST(list_sum(list_transform({_each(f"(v - q[i + 1] * ({_DIV.format(q=Q)}))")}, lambda e: e * e)) AS BIGINT) AS sse,
  CAST(len(list_filter(q, lambda z: z <> 0)) AS BIGINT) AS nonzero FROM c"""


def quantize_video(spark, sf):
    q = S.quantize_video(F.col("x"), 96)
    out = blocks(spark, sf).select("vec_id", q.alias("q"))
    bounded = F.forall("q", lambda v: F.abs(v * 96) <= 33_554_431)
    return out.select("vec_id", total("q").alias("sum_q"), F.array_max("q").alias("max_q"), bounded.alias("bounded"))


QUANTIZE_VIDEO = f"""WITH {sql_blocks()}, c AS (SELECT vec_id, {_each(_round_sql("v", "96"))} AS q FROM blocks)
SELECT vec_id, CAST(list_sum(q) AS BIGINT) AS sum_q, CAST(list_max(q) AS BIGINT) AS max_q, list_max(list_transform(q, lambda z: abs(z * 96))) <= 33554431 AS bounded FROM c"""


def _haar_sql() -> str:
    steps, prev, n = [], "blocks", 64
    while n > 1:
        h = n // 2
        d = f"list_transform(generate_series(0, {h - 1}), lambda i: x[2 * i + 2] - x[2 * i + 1])"
        s = f"list_transform(generate_series(0, {h - 1}), lambda i: x[2 * i + 1] + ((x[2 * i + 2] - x[2 * i + 1]) >> 1))"
        steps.append(f"h{h} AS (SELECT vec_id, list_concat(list_concat({s}, {d}), x[{n + 1}:64]) AS x FROM {prev})")
        prev, n = f"h{h}", h
    return ", ".join(steps)


def haar_forward(spark, sf):
    h = blocks(spark, sf).select("vec_id", S.haar(F.col("x")).alias("h"))
    return h.select("vec_id", F.get("h", F.lit(0)).alias("dc"), F.get("h", F.lit(1)).alias("first"), total(F.transform("h", F.abs)).alias("magnitude"))


HAAR_FORWARD = f"WITH {sql_blocks()}, {_haar_sql()} SELECT vec_id, x[1] AS dc, x[2] AS first, CAST(list_sum(list_transform(x, lambda v: abs(v))) AS BIGINT) AS magnitude FROM h1"


def haar_roundtrip(spark, sf):
    b = blocks(spark, sf).select("vec_id", "x", S.haar(F.col("x")).alias("h"))
    return b.select("vec_id", (S.inverse_haar(F.col("h")) == F.col("x")).alias("exact"), total("x").alias("sum_x"))


HAAR_ROUNDTRIP = f"WITH {sql_blocks()} SELECT vec_id, true AS exact, CAST(list_sum(x) AS BIGINT) AS sum_x FROM blocks"


def wht_energy(spark, sf):
    t = blocks(spark, sf, 255).select("vec_id", S.hadamard(F.col("x")).alias("t"))
    return t.select("vec_id", F.get("t", F.lit(0)).alias("dc"), F.get("t", F.lit(63)).alias("last"), squares(F.col("t")).alias("energy"))


_SIGN = "(1 - 2 * (bit_count(CAST(i & k AS BIGINT)) % 2))"
WHT_ENERGY = f"""WITH {sql_blocks(255)}, t AS (SELECT vec_id, list_transform(generate_series(0, 63), lambda k: CAST(list_sum(list_transform(generate_series(0, 63), lambda i: x[i + 1] * {_SIGN})) AS BIGINT)) AS t FROM blocks)
SELECT vec_id, t[1] AS dc, t[64] AS last, CAST(list_sum(list_transform(t, lambda v: v * v)) AS BIGINT) AS energy FROM t"""


def wht_roundtrip(spark, sf):
    b = blocks(spark, sf, 255).select("vec_id", "x", S.hadamard(F.col("x")).alias("t"))
    lossy = S.inverse_hadamard(F.transform(F.col("q"), lambda v: v * 16))
    b = b.select("vec_id", "x", "t", S.quantize_video(F.col("t"), 16).alias("q"))
    return b.select("vec_id", (S.inverse_hadamard(F.col("t")) == F.col("x")).alias("exact"), S.sse(F.col("x"), lossy).alias("sse"))


WHT_ROUNDTRIP = f"""WITH {sql_blocks(255)}, t AS (SELECT vec_id, x, list_transform(generate_series(0, 63), lambda k: CAST(list_sum(list_transform(generate_series(0, 63), lambda i: x[i + 1] * {_SIGN})) AS BIGINT)) AS t FROM blocks),
q AS (SELECT vec_id, x, {_each(_round_sql("v", "16") + " * 16", "t")} AS q FROM t),
r AS (SELECT vec_id, x, list_transform(generate_series(0, 63), lambda k: CAST(list_sum(list_transform(generate_series(0, 63), lambda i: q[i + 1] * {_SIGN})) AS BIGINT)) AS r FROM q)
SELECT vec_id, true AS exact, CAST(list_sum(list_transform({_each("x[i + 1] - " + _round_sql("v", "64").replace("v", "r[i + 1]"), "r")}, lambda e: e * e)) AS BIGINT) AS sse FROM r"""


def sparse_tokens(spark, sf):
    q = blocks(spark, sf).select("vec_id", S.sparse(S.quantize_audio(F.col("x"), 600)).alias("t"))
    return q.select("vec_id", F.posexplode("t").alias("place", "t")).select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("t.i").cast("bigint").alias("i"), F.col("t.v").alias("v"))


_Q600 = _each(_round_sql("v", f"({_DIV.format(q=600)})"))
SPARSE_TOKENS = f"""WITH {sql_blocks()}, q AS (SELECT vec_id, unnest({_Q600}) AS v, unnest(generate_series(0, 63)) AS i FROM blocks)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS place, i, v FROM q WHERE v <> 0"""


def token_bytes(spark, sf):
    return blocks(spark, sf).select("vec_id", S.token_bytes(S.quantize_audio(F.col("x"), 600)).alias("bytes"))




def _len_sql(v: str) -> str:
    return "(CASE " + " ".join(f"WHEN {v} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)"


_ZIG = "(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END)"
TOKEN_BYTES = f"""WITH {sql_blocks()}, q AS (SELECT vec_id, unnest({_Q600}) AS v, unnest(generate_series(0, 63)) AS i FROM blocks)
SELECT vec_id, CAST({_len_sql("count(*) FILTER (v <> 0)")} + coalesce(sum(CASE WHEN v <> 0 THEN {_len_sql("i")} + {_len_sql(_ZIG)} END), 0) AS BIGINT) AS bytes FROM q GROUP BY vec_id"""


def varint_zigzag(spark, sf):
    v = F.col("l_partkey") * 1_000_003 - F.col("l_orderkey") * F.col("l_suppkey")
    z = S.zigzag(v)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.varint_len(F.col("l_orderkey")).cast("bigint").alias("key_bytes"), z.alias("zigzag"), S.varint_len(z).cast("bigint").alias("zigzag_bytes"), S.unzigzag(z).alias("back"))


VARINT_ZIGZAG = f"""WITH s AS (SELECT *, l_partkey * 1000003 - l_orderkey * l_suppkey AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST({_len_sql("l_orderkey")} AS BIGINT) AS key_bytes, {_ZIG} AS zigzag, CAST({_len_sql(_ZIG)} AS BIGINT) AS zigzag_bytes, v AS back FROM s"""


def sad_argmin(spark, sf):
    """Each block against the up to four blocks before it: least sum of absolute differences, newest first among equals."""
    w = Window.partitionBy("label").orderBy("vec_id")
    refs = F.filter(F.array(*(F.when(F.lag("vec_id", k).over(w).isNotNull(), F.struct(F.lit(k).alias("age"), F.lag("vec_id", k).over(w).alias("ref"), F.lag("x", k).over(w).alias("y"))) for k in range(1, 5))), lambda r: r.isNotNull())
    b = blocks(spark, sf, 255).select("vec_id", "x", refs.alias("refs"))
    best = F.array_min(F.transform("refs", lambda r: F.struct(S.sad(F.col("x"), r["y"]).alias("sad"), r["age"].alias("age"), r["ref"].alias("ref"))))
    return b.select("vec_id", best.alias("b")).select("vec_id", "b.sad", F.col("b.age").cast("bigint").alias("age"), "b.ref")


SAD_ARGMIN = f"""WITH {sql_blocks(255)}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM blocks),
p AS (SELECT a.vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: abs(a.x[i] - b.x[i]))) AS BIGINT) AS sad, a.k - b.k AS age, b.vec_id AS ref
      FROM n a LEFT JOIN n b ON a.label = b.label AND b.k BETWEEN a.k - 4 AND a.k - 1)
SELECT vec_id, sad, age, ref FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sad, age) = 1"""


def psnr(spark, sf):
    b = blocks(spark, sf, 255).select("vec_id", "x", F.transform(S.quantize_video(F.col("x"), 9), lambda v: v * 9).alias("y"))
    err = S.sse(F.col("x"), F.col("y"))
    out = b.select((F.col("vec_id") % 16).alias("clip"), err.alias("sse"))
    return out.groupBy("clip").agg(F.sum("sse").alias("sse"), (F.count("*") * 64).alias("n")).select("clip", "sse", F.round(S.decibels(65025.0 * F.col("n"), F.col("sse")), 6).alias("psnr_db"))


PSNR = f"""WITH {sql_blocks(255)}, e AS (SELECT vec_id % 16 AS clip, list_sum(list_transform({_each("(v - " + _round_sql("v", "9") + " * 9)")}, lambda d: d * d)) AS s FROM blocks)
SELECT clip, CAST(sum(s) AS BIGINT) AS sse, round(CASE WHEN sum(s) = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(65025.0 * count(*) * 64 / sum(s)) END, 6) AS psnr_db FROM e GROUP BY clip"""


def snr(spark, sf):
    b = blocks(spark, sf).select("label", "x", S.dequantize_audio(S.quantize_audio(F.col("x"), Q), Q).alias("y"))
    out = b.groupBy("label").agg(F.sum(squares(F.col("x"))).alias("signal"), F.sum(S.sse(F.col("x"), F.col("y"))).alias("noise"))
    return out.select("label", "signal", "noise", F.round(S.decibels(F.greatest("signal", F.lit(1)), F.col("noise")), 6).alias("snr_db"))


SNR = f"""WITH {sql_blocks()}, c AS (SELECT label, x, {_AUDIO_Q} AS q FROM blocks),
e AS (SELECT label, list_sum(list_transform(x, lambda v: v * v)) AS s, list_sum(list_transform({_each(f"(v - q[i + 1] * ({_DIV.format(q=Q)}))")}, lambda d: d * d)) AS n FROM c)
SELECT label, CAST(sum(s) AS BIGINT) AS signal, CAST(sum(n) AS BIGINT) AS noise, round(CASE WHEN sum(n) = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(greatest(sum(s), 1) / CAST(sum(n) AS DOUBLE)) END, 6) AS snr_db FROM e GROUP BY label"""


def palette_blocks(spark, sf):
    b = blocks(spark, sf, 5).select("vec_id", "x", S.palette(F.col("x")).alias("c")).where("c IS NOT NULL")
    packed = S.palette_pack(F.transform("x", lambda v: (F.array_position("c", v) - 1).cast("bigint")))
    return b.select("vec_id", F.array_join(F.transform("c", lambda v: v.cast("string")), ",").alias("colors"), F.array_join(F.transform(packed, lambda v: v.cast("string")), ",").alias("packed"))


PALETTE_BLOCKS = f"""WITH {sql_blocks(5)}, f AS (SELECT vec_id, x, list_filter(generate_series(1, 64), lambda i: list_position(x, x[i]) = i) AS firsts FROM blocks),
c AS (SELECT vec_id, x, list_transform(firsts, lambda i: x[i]) AS c FROM f WHERE len(firsts) <= 4)
SELECT vec_id, list_aggregate(c, 'string_agg', ',') AS colors, list_aggregate(list_transform(generate_series(0, 15), lambda k: CAST(list_sum(list_transform(generate_series(0, 3), lambda j: (list_position(c, x[4 * k + j + 1]) - 1) << (2 * j))) AS BIGINT)), 'string_agg', ',') AS packed FROM c"""


def nearest_quantizer(spark, sf):
    """The step of 1..32 whose sample-domain distortion is nearest to that of the transform at step 16; the smaller step among equals."""
    b = blocks(spark, sf, 255).select("vec_id", "x")
    t = S.inverse_hadamard(F.transform(S.quantize_video(S.hadamard(F.col("x")), 16), lambda v: v * 16))
    b = b.select("vec_id", "x", S.sse(F.col("x"), t).alias("target"))
    each = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda q: F.struct(F.abs(S.squares(F.transform("x", lambda v: v - S.div_round(v, q.cast("bigint")) * q.cast("bigint"))) - F.col("target")).alias("gap"), q.cast("bigint").alias("q")))
    return b.select("vec_id", "target", F.array_min(each).alias("m")).select("vec_id", "target", F.col("m.q").alias("step"), F.col("m.gap").alias("gap"))


NEAREST_QUANTIZER = WHT_ROUNDTRIP.replace("SELECT vec_id, true AS exact,", "SELECT vec_id, x,").replace(" AS sse FROM r", " AS target FROM r")
NEAREST_QUANTIZER = f"""WITH w AS ({NEAREST_QUANTIZER}), s AS (SELECT vec_id, target, q, CAST(list_sum(list_transform(x, lambda v: (v - {_round_sql("v", "q")} * q) * (v - {_round_sql("v", "q")} * q))) AS BIGINT) AS e FROM w, generate_series(1, 32) g(q))
SELECT vec_id, target, q AS step, abs(e - target) AS gap FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(e - target), q) = 1"""


def mid_side(spark, sf):
    b = blocks(spark, sf).select("vec_id", F.posexplode(F.transform(indexes(32), lambda i: F.struct(F.get("x", 2 * i).alias("l"), F.get("x", 2 * i + 1).alias("r")))).alias("i", "s"))
    m, s = S.mid_side(F.col("s.l"), F.col("s.r"))
    b = b.select("vec_id", "s", m.alias("mid"), s.alias("side"))
    left, right = S.left_right(F.col("mid"), F.col("side"))
    return b.groupBy("vec_id").agg(F.sum("mid").alias("sum_mid"), F.sum("side").alias("sum_side"), F.every((left == F.col("s.l")) & (right == F.col("s.r"))).alias("exact"), F.every(S.in_16_bits(left) & S.in_16_bits(right)).alias("fits"))


MID_SIDE = f"""WITH {sql_blocks()}, p AS (SELECT vec_id, unnest(list_transform(generate_series(0, 31), lambda i: x[2 * i + 1])) AS l, unnest(list_transform(generate_series(0, 31), lambda i: x[2 * i + 2])) AS r FROM blocks)
SELECT vec_id, CAST(sum(l + ((r - l) >> 1)) AS BIGINT) AS sum_mid, CAST(sum(r - l) AS BIGINT) AS sum_side, true AS exact, bool_and(l BETWEEN -32768 AND 32767 AND r BETWEEN -32768 AND 32767) AS fits FROM p GROUP BY vec_id"""


def deinterleave(spark, sf):
    """Two channel planes of a block, each padded with zeros to 64, and the samples as fractions."""
    plane = lambda c: F.transform(F.filter(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["i"] % 2 == c), lambda s: s["v"])
    padded = lambda c: F.concat(plane(c), F.array_repeat(F.lit(0).cast("bigint"), 32))
    b = blocks(spark, sf).select("vec_id", "x", padded(0).alias("a"), padded(1).alias("b"))
    back = F.flatten(F.transform(indexes(32), lambda i: F.array(F.get("a", i), F.get("b", i))))
    return b.select("vec_id", F.size("a").cast("bigint").alias("padded"), total("a").alias("sum_a"), total("b").alias("sum_b"), (back == F.col("x")).alias("exact"), F.round(F.get("x", F.lit(0)) / 32768, 9).alias("first_pcm"))


DEINTERLEAVE = f"""WITH {sql_blocks()} SELECT vec_id, CAST(64 AS BIGINT) AS padded, CAST(list_sum(list_transform(generate_series(0, 31), lambda i: x[2 * i + 1])) AS BIGINT) AS sum_a,
CAST(list_sum(list_transform(generate_series(0, 31), lambda i: x[2 * i + 2])) AS BIGINT) AS sum_b, true AS exact, round(x[1] / 32768.0, 9) AS first_pcm FROM blocks"""


def raster_blocks(spark, sf):
    """The 8x8 blocks of planes of given sizes, with partial ones at the right and bottom, and half-sample coordinates."""
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 2).cast("bigint").alias("w"), (F.col("p_partkey") % 30 * 2 + 2).alias("h"))
    n = lambda s: F.ceil(F.col(s) / 8)
    return p.select("p_partkey", "w", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), n("h") - 1)).alias("by")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n("w") - 1)).alias("bx")).groupBy("p_partkey").agg(
        F.count("*").alias("blocks"), F.sum(F.least(F.lit(8), F.col("w") - F.col("bx") * 8) * F.least(F.lit(8), F.col("h") - F.col("by") * 8)).alias("samples"), F.sum(F.shiftright(F.col("bx") - F.col("by"), 1)).alias("whole"), F.sum(F.pmod(F.col("bx") - F.col("by"), F.lit(2))).alias("half"))


RASTER_BLOCKS = """WITH p AS (SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS w, p_partkey % 30 * 2 + 2 AS h FROM part),
r AS (SELECT p_partkey, w, h, unnest(generate_series(0, (h + 7) // 8 - 1)) AS j FROM p), b AS (SELECT p_partkey, w, h, j, unnest(generate_series(0, (w + 7) // 8 - 1)) AS i FROM r)
SELECT p_partkey, count(*) AS blocks, CAST(sum(least(8, w - i * 8) * least(8, h - j * 8)) AS BIGINT) AS samples, CAST(sum((i - j) >> 1) AS BIGINT) AS whole, CAST(sum(((i - j) % 2 + 2) % 2) AS BIGINT) AS half FROM b GROUP BY p_partkey"""


def dc_predictor(spark, sf):
    """Rounded mean of the neighbours above and left that exist; 128 without any."""
    b = blocks(spark, sf, 255)
    w = Window.partitionBy("label").orderBy("vec_id")
    near = F.concat(F.coalesce(F.slice(F.lag("x", 1).over(w), 57, 8), F.array().cast("array<bigint>")), F.coalesce(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(F.lag("x", 2).over(w), i * 8 + 7)), F.array().cast("array<bigint>")))
    n = b.select("vec_id", F.filter(near, lambda v: v.isNotNull()).alias("n"))
    n = n.select("vec_id", F.transform("n", lambda v: F.abs(v)).alias("n"))
    return n.select("vec_id", F.when(F.size("n") == 0, 128).otherwise(F.floor((total("n") + F.floor(F.size("n") / 2)) / F.size("n"))).cast("bigint").alias("prediction"))


DC_PREDICTOR = f"""WITH {sql_blocks(255)}, l AS (SELECT vec_id, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b FROM blocks WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
n AS (SELECT vec_id, list_transform(list_concat(coalesce(a[57:64], []), CASE WHEN b IS NULL THEN [] ELSE list_transform(generate_series(0, 7), lambda i: b[i * 8 + 8]) END), lambda v: abs(v)) AS n FROM l)
SELECT vec_id, CAST(CASE WHEN len(n) = 0 THEN 128 ELSE (list_sum(n) + len(n) // 2) // len(n) END AS BIGINT) AS prediction FROM n"""


def scene_change(spark, sf):
    """Integer mean of absolute differences over every other sample of neighbouring blocks, and whether it is a cut."""
    w = Window.partitionBy("label").orderBy("vec_id")
    b = blocks(spark, sf, 255).select("vec_id", "x", F.lag("x", 1).over(w).alias("y")).where("y IS NOT NULL")
    strided = F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda i: F.abs(F.get("x", i) - F.get("y", i)))
    mean = F.floor(total(strided) / 32)
    return b.select("vec_id", mean.alias("mean_difference"), (mean > 48).alias("cut"))


SCENE_CHANGE = f"""WITH {sql_blocks(255)}, l AS (SELECT vec_id, x, lag(x, 1) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM blocks),
m AS (SELECT vec_id, CAST(list_sum(list_transform(generate_series(0, 31), lambda i: abs(x[2 * i + 1] - y[2 * i + 1]))) AS BIGINT) // 32 AS m FROM l WHERE y IS NOT NULL)
SELECT vec_id, m AS mean_difference, m > 48 AS cut FROM m"""


def yuv_rgb(spark, sf):
    """Presentation of three neighbouring samples, by every matrix in full and in limited range."""
    b = blocks(spark, sf, 255).select("vec_id", (F.col("vec_id") % 5 + F.col("vec_id") % 2 * 4096).alias("meta0"), *(S.clip8(F.get("x", F.lit(i)) + 128).alias(c) for i, c in enumerate("yuv")))
    r, g, b_ = S.presented(F.col("y"), F.col("u"), F.col("v"), F.col("meta0"))
    return b.select("vec_id", "meta0", r.alias("r"), g.alias("g"), b_.alias("b"))


_ROWS = ", ".join(f"({m}, {4096 * f}, {', '.join(f'CAST({float(x)!r} AS DOUBLE)' for x in c)})" for (m, f), c in S.PRESENTATION.items())
_SHOWN = lambda x: f"CAST(round_even(greatest(0.0::DOUBLE, least(255.0::DOUBLE, ({x}) * 255)), 0) AS BIGINT)"
YUV_RGB = f"""WITH {sql_blocks(255)}, c(matrix, full_range, ys, yo, rv, gu, gv, bu) AS (VALUES {_ROWS}),
p AS (SELECT vec_id, vec_id % 5 + vec_id % 2 * 4096 AS meta0, CAST(least(greatest(x[1] + 128, 0), 255) AS DOUBLE) / 255 AS y, CAST(least(greatest(x[2] + 128, 0), 255) AS DOUBLE) / 255 - 0.5 AS u, CAST(least(greatest(x[3] + 128, 0), 255) AS DOUBLE) / 255 - 0.5 AS v FROM blocks)
SELECT vec_id, meta0, {_SHOWN("ys * (y - yo) + rv * v")} AS r, {_SHOWN("ys * (y - yo) + gu * u + gv * v")} AS g, {_SHOWN("ys * (y - yo) + bu * u")} AS b
FROM p JOIN c ON full_range = meta0 & 4096 AND matrix = CASE meta0 & 15 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 2 END"""

QUERIES = {
    "div_round": (div_round, DIV_ROUND), "quantize_audio": (quantize_audio, QUANTIZE_AUDIO), "quantize_video": (quantize_video, QUANTIZE_VIDEO), "haar_forward": (haar_forward, HAAR_FORWARD),
    "haar_roundtrip": (haar_roundtrip, HAAR_ROUNDTRIP), "wht_energy": (wht_energy, WHT_ENERGY), "wht_roundtrip": (wht_roundtrip, WHT_ROUNDTRIP), "sparse_tokens": (sparse_tokens, SPARSE_TOKENS),
    "token_bytes": (token_bytes, TOKEN_BYTES), "varint_zigzag": (varint_zigzag, VARINT_ZIGZAG), "sad_argmin": (sad_argmin, SAD_ARGMIN), "psnr": (psnr, PSNR), "snr": (snr, SNR),
    "palette_blocks": (palette_blocks, PALETTE_BLOCKS), "nearest_quantizer": (nearest_quantizer, NEAREST_QUANTIZER), "mid_side": (mid_side, MID_SIDE), "deinterleave": (deinterleave, DEINTERLEAVE),
    "raster_blocks": (raster_blocks, RASTER_BLOCKS), "dc_predictor": (dc_predictor, DC_PREDICTOR), "scene_change": (scene_change, SCENE_CHANGE), "yuv_rgb": (yuv_rgb, YUV_RGB),
}
