"""Queries over packets, streams, epochs and runs: lookups, windows, orders, aggregates, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.llm.segments import give_back
from tessera.llm.store import bounded_batches
from tessera.operators.ordered import running

from .carriers import PACKETS, STREAMS, packets, read, streams

_MEDIA = "kind IN (2, 3)"
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def verify_counts(spark, sf):
    """Epochs, video frames and audio packets of every file and stream."""
    return packets(spark, sf).where("kind <= 3").groupBy("file_id", "kind", "stream_id").agg(F.count("*").alias("n"), F.sum("payload_len").alias("bytes"))


VERIFY_COUNTS = f"WITH {PACKETS} SELECT file_id, kind, stream_id, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM packets WHERE kind <= 3 GROUP BY ALL"


def packet_interleave(spark, sf):
    """Place of each packet of a file: epoch starts first, then pts, then video, audio, metadata, then source order."""
    first = F.when(F.col("kind") == 1, F.lit(-(1 << 62))).otherwise(F.col("pts"))  # starts before all times
    out = running(packets(spark, sf), "file_id", [first, F.col("pts"), F.col("kind"), F.col("seq")], {"place": F.lit(1)})
    return out.select("file_id", "seq", "place")


PACKET_INTERLEAVE = f"WITH {PACKETS} SELECT file_id, seq, row_number() OVER (PARTITION BY file_id ORDER BY kind <> 1, pts, kind, seq) AS place FROM packets"


def route_lookup(spark, sf):
    """Each media packet's stream; a missing stream or one of the other kind is rejected."""
    p = packets(spark, sf).where(_MEDIA).join(streams(spark, sf), "stream_id", "left")
    return p.select("seq", "stream_id", F.when(F.col("media_kind").isNull() | (F.col("media_kind") != F.col("kind")), "BadStream").alias("error_code"))


ROUTE_LOOKUP = f"WITH {PACKETS}, {STREAMS} SELECT seq, p.stream_id, CASE WHEN media_kind IS NULL OR media_kind <> kind THEN 'BadStream' END AS error_code FROM packets p LEFT JOIN streams s USING (stream_id) WHERE kind IN (2, 3)"


def orphan_packets(spark, sf):
    return packets(spark, sf).where(_MEDIA).join(streams(spark, sf), "stream_id", "left_anti").select("seq", "stream_id", "kind")


ORPHAN_PACKETS = f"WITH {PACKETS}, {STREAMS} SELECT seq, stream_id, kind FROM packets WHERE kind IN (2, 3) AND stream_id NOT IN (SELECT stream_id FROM streams)"


def _by_pts():
    return Window.partitionBy("stream_id").orderBy("pts", "seq")


def epoch_fixed(spark, sf):
    """Epochs of sixteen packets, counted from each stream's start."""
    return packets(spark, sf).select("seq", F.floor((F.row_number().over(_by_pts()) - 1) / 16).alias("epoch"))


EPOCH_FIXED = f"WITH {PACKETS} SELECT seq, (row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1) // 16 AS epoch FROM packets"


def epoch_scene_cut(spark, sf):
    """A new epoch at every fourth index of a stream (whatever the cuts), or where a turn's length jumps by more than 48."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    t = t.select("*", (F.row_number().over(w) - 1).alias("i"), F.lag("n").over(w).alias("before"))
    start = (F.col("i") % 4 == 0) | F.coalesce(F.abs(F.col("n") - F.col("before")) > 48, F.lit(False))
    return t.select("conv_id", "turn", F.sum(start.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("epoch"))


EPOCH_SCENE_CUT = """WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
l AS (SELECT *, row_number() OVER w - 1 AS i, lag(n) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(CASE WHEN i % 4 = 0 OR coalesce(abs(n - before) > 48, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM l"""


def audio_epochs(spark, sf):
    """Audio-only grouping: packet and epoch of a sample index at 48 kHz, with its ticks."""
    s = F.col("l_orderkey") * 977 + F.col("l_linenumber") * 131
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(s / 960).alias("packet"), F.floor(s / 96_000).alias("epoch"), S.sample_ticks(s, 48_000).alias("pts"))


AUDIO_EPOCHS = """WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey * 977 + l_linenumber * 131 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, s // 960 AS packet, s // 96000 AS epoch, s * 1000000 // 48000 AS pts FROM s"""


def _epoch_sizes(spark, sf) -> DataFrame:
    """Orders as epochs of a customer's file: bytes of their packets."""
    size = F.col("l_partkey") % 500 + 32
    e = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(size).alias("length"), F.count("*").alias("packets"))
    return e.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), e.l_orderkey == F.col("o_orderkey")).select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("epoch_id"), "length", "packets")


_SIZES = """sizes AS (SELECT o_custkey AS file_id, o_orderkey AS epoch_id, CAST(sum(l_partkey % 500 + 32) AS BIGINT) AS length, count(*) AS packets FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def front_offsets(spark, sf):
    """Byte offset of each epoch: what precedes it, after a prefix whose length the number of epochs decides."""
    sizes = _epoch_sizes(spark, sf)
    counts = sizes.groupBy("file_id").agg(F.count("*").alias("epochs"))
    out = running(sizes, "file_id", [F.col("epoch_id")], {"run": F.col("length")}).join(counts, "file_id")
    return out.select("file_id", "epoch_id", "length", (32 + 12 + 24 + 32 * F.col("epochs") + 4 + F.col("run") - F.col("length")).alias("byte_offset"))


FRONT_OFFSETS = f"""WITH {_SIZES} SELECT file_id, epoch_id, length, CAST(72 + 32 * count(*) OVER (PARTITION BY file_id) + sum(length) OVER (PARTITION BY file_id ORDER BY epoch_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS byte_offset FROM sizes"""


def packet_offsets(spark, sf):
    size = F.col("l_partkey") % 500 + 32
    run = F.sum(size).over(Window.partitionBy("l_orderkey").orderBy(*_LINE).rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (run - size).alias("byte_offset"))


PACKET_OFFSETS = "SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey % 500 + 32) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - (l_partkey % 500 + 32) AS BIGINT) AS byte_offset FROM lineitem"


def seek_epoch(spark, sf):
    """For each metadata packet the last epoch start at or before it in its file, else the file's first: one ordered pass, no range join."""
    p = packets(spark, sf).where("kind IN (1, 4)").select("file_id", "seq", "kind", "pts")
    start = F.when(F.col("kind") == 1, F.col("seq"))
    first = p.where("kind = 1").groupBy("file_id").agg(F.min(F.struct("pts", "seq"))["seq"].alias("first"))
    out = running(p, "file_id", [F.col("pts"), (F.col("kind") != 1).cast("int"), F.col("seq")], lasts={"before": start}).where("kind = 4").join(first, "file_id", "left")
    return out.select("seq", F.coalesce("before", "first").alias("epoch_seq"))


SEEK_EPOCH = f"""WITH {PACKETS}, e AS (SELECT * FROM packets WHERE kind = 1), f AS (SELECT file_id, arg_min(seq, pts) AS first FROM e GROUP BY file_id)
SELECT m.seq, coalesce(e.seq, f.first) AS epoch_seq FROM (SELECT * FROM packets WHERE kind = 4) m LEFT JOIN f ON m.file_id = f.file_id ASOF LEFT JOIN e ON m.file_id = e.file_id AND m.pts >= e.pts"""


def reindex_groups(spark, sf):
    """The epoch start before each packet of a file; packets before the first have none."""
    p = packets(spark, sf).select("file_id", "seq", "kind")
    return running(p, "file_id", [F.col("seq")], lasts={"epoch_seq": F.when(F.col("kind") == 1, F.col("seq"))}).select("file_id", "seq", "epoch_seq")


REINDEX_GROUPS = f"WITH {PACKETS} SELECT file_id, seq, max(CASE WHEN kind = 1 THEN seq END) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch_seq FROM packets"


def media_before_epoch(spark, sf):
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = packets(spark, sf).select("stream_id", "seq", "kind", F.max((F.col("kind") == 1).cast("int")).over(w).alias("open"))
    return p.where(_MEDIA).where("open = 0").select("stream_id", "seq", F.lit("BadEpoch").alias("error_code"))


MEDIA_BEFORE_EPOCH = f"""WITH {PACKETS}, p AS (SELECT *, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS open FROM packets)
SELECT stream_id, seq, 'BadEpoch' AS error_code FROM p WHERE kind IN (2, 3) AND open = 0"""


def ref_window(spark, sf):
    """The up to four frames that a stream retains before each of its frames, newest first."""
    w = Window.partitionBy("stream_id").orderBy("pts", "seq").rowsBetween(-4, -1)
    refs = F.array_join(F.reverse(F.collect_list(F.col("seq").cast("string")).over(w)), ",")
    return packets(spark, sf).where("kind = 2").select("stream_id", "seq", refs.alias("refs"))


REF_WINDOW = f"WITH {PACKETS} SELECT stream_id, seq, coalesce(array_to_string(list_reverse(list(CAST(seq AS VARCHAR)) OVER (PARTITION BY stream_id ORDER BY pts, seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), ','), '') AS refs FROM packets WHERE kind = 2"


def missing_dependencies(spark, sf):
    """Declared dependencies that are not among the up to four frames retained before, or that have another size.

    Each frame declares the frame one to six places back in its stream, and a frame by its bare id, which may be any.
    """
    w = Window.partitionBy("stream_id").orderBy("pts", "seq")
    size = lambda c: F.col(c) % 16
    p = packets(spark, sf).where("kind = 2")
    back = F.coalesce(*(F.when(F.col("seq") % 6 + 1 == k, F.lag("seq", k).over(w)) for k in range(1, 7)))
    kept = F.collect_list(F.struct("seq", size("payload_len").alias("size"))).over(w.rowsBetween(-4, -1))
    p = p.select("stream_id", "seq", size("payload_len").alias("size"), F.array_distinct(F.array_compact(F.array(back, F.col("seq") - 3))).alias("deps"), kept.alias("kept"))
    d = p.select("stream_id", "seq", "size", "kept", F.explode("deps").alias("dep"))
    found = F.filter("kept", lambda k: k["seq"] == F.col("dep"))
    d = d.select("stream_id", "seq", "dep", F.when(F.size(found) == 0, "ReferenceMissing").when(F.get(found, F.lit(0))["size"] != F.col("size"), "ReferenceSize").alias("error_code"))
    return d.where("error_code IS NOT NULL")


MISSING_DEPENDENCIES = f"""WITH {PACKETS}, r AS (SELECT *, payload_len % 16 AS size, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) AS k FROM packets WHERE kind = 2),
d AS (SELECT a.stream_id, a.seq, a.size, a.k, b.seq AS dep FROM r a JOIN r b ON a.stream_id = b.stream_id AND b.k = a.k - (a.seq % 6 + 1) UNION SELECT stream_id, seq, size, k, seq - 3 FROM r)
SELECT d.stream_id, d.seq, d.dep, CASE WHEN e.seq IS NULL THEN 'ReferenceMissing' ELSE 'ReferenceSize' END AS error_code FROM d LEFT JOIN r e ON d.stream_id = e.stream_id AND d.dep = e.seq AND e.k BETWEEN d.k - 4 AND d.k - 1 WHERE e.seq IS NULL OR e.size <> d.size"""


def range_violations(spark, sf):
    """Epoch ranges that leave a file of a claimed size, and files whose ids repeat."""
    o = front_offsets(spark, sf)
    claimed = 6_000 + F.col("file_id") % 7 * 500
    return o.where(F.col("byte_offset") + F.col("length") > claimed).select("file_id", "epoch_id", F.lit("BadFront").alias("error_code"))


RANGE_VIOLATIONS = f"WITH o AS ({FRONT_OFFSETS}) SELECT file_id, epoch_id, 'BadFront' AS error_code FROM o WHERE byte_offset + length > 6000 + file_id % 7 * 500"


def unique_stream(spark, sf):
    """Files with exactly one stream of a kind, as a selection needs."""
    n = packets(spark, sf).where(_MEDIA).groupBy("file_id", "kind").agg(F.countDistinct("stream_id").alias("streams"))
    return n.select("file_id", "kind", "streams", (F.col("streams") == 1).alias("selectable"))


UNIQUE_STREAM = f"WITH {PACKETS} SELECT file_id, kind, count(DISTINCT stream_id) AS streams, count(DISTINCT stream_id) = 1 AS selectable FROM packets WHERE kind IN (2, 3) GROUP BY ALL"


def trim_audio(spark, sf):
    """Audio packets of 20 ms that overlap a start, and the samples to skip of each."""
    p = packets(spark, sf).where("kind = 3")
    w = Window.partitionBy("stream_id")
    p = p.select("stream_id", "seq", "pts", (F.min("pts").over(w) + 86_400_000_000 * 3).alias("start"))
    skip = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("pts")) * 48_000 / 1_000_000)).cast("bigint")
    return p.where(F.col("pts") + 3_600_000_000 > F.col("start")).select("stream_id", "seq", skip.alias("skip"))


TRIM_AUDIO = f"""WITH {PACKETS}, p AS (SELECT *, min(pts) OVER (PARTITION BY stream_id) + 86400000000 * 3 AS start FROM packets WHERE kind = 3)
SELECT stream_id, seq, CAST(greatest(0, (start - pts) * 48000 // 1000000) AS BIGINT) AS skip FROM p WHERE pts + 3600000000 > start"""


def audio_to_epoch(spark, sf):
    """Audio packets of each epoch [pts, next pts) of their file; those after the last video epoch are dropped."""
    p = packets(spark, sf).where("kind <= 3").select("file_id", "seq", "kind", "pts")
    last = p.where("kind = 2").groupBy("file_id").agg(F.max("pts").alias("end"))
    start = F.when(F.col("kind") == 1, F.col("seq"))
    p = running(p, "file_id", [F.col("pts"), (F.col("kind") != 1).cast("int"), F.col("seq")], lasts={"epoch_seq": start}).join(last, "file_id")
    return p.where("kind = 3 AND epoch_seq IS NOT NULL AND pts < end").groupBy("file_id", "epoch_seq").agg(F.count("*").alias("audio_packets"))


AUDIO_TO_EPOCH = f"""WITH {PACKETS}, e AS (SELECT file_id, seq, pts, lead(pts) OVER (PARTITION BY file_id ORDER BY pts, seq) AS next FROM packets WHERE kind = 1),
v AS (SELECT file_id, max(pts) AS last FROM packets WHERE kind = 2 GROUP BY file_id)
SELECT a.file_id, e.seq AS epoch_seq, count(*) AS audio_packets FROM packets a JOIN e ON a.file_id = e.file_id AND a.pts >= e.pts AND (e.next IS NULL OR a.pts < e.next) JOIN v ON a.file_id = v.file_id AND a.pts < v.last WHERE a.kind = 3 GROUP BY ALL"""


def nearest_rank(values: Column, num: int, den: int) -> Column:
    """The value at index (n - 1) * num div den of a sorted array."""
    return F.get(values, F.floor((F.size(values) - 1) * num / den).cast("int"))


def nearest_rank_pct(spark, sf):
    """p10, p50 and p90 by the nearest lower rank: counts by value first, so no group is gathered."""
    c = read(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    c = c.select("*", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p / 100), F.col("value")))
    return c.groupBy("event_type").agg(*(pick(p).alias(f"p{p}") for p in (10, 50, 90)))


NEAREST_RANK_PCT = """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[(len(v) - 1) * 10 // 100 + 1] AS p10, v[(len(v) - 1) * 50 // 100 + 1] AS p50, v[(len(v) - 1) * 90 // 100 + 1] AS p90 FROM l"""


#: Fixed values of the gate: the rate that counts as larger, the gains of PSNR and SSIM that make up for it, the losses of
#: each that count, the rate that makes up for these, and the factor of total time that fails.
LARGER, GAIN_PSNR, GAIN_SSIM, LOSS_PSNR, LOSS_SSIM, SMALLER, SLOWER = 1.05, 0.10, 0.0005, -0.50, -0.003, 0.97, 1.75


def gate(base: DataFrame, head: DataFrame) -> DataFrame:
    """(rule, cases, ratio): what a later run (case_id, source_hash, bytes, psnr_db, ssim, encode_s, decode_s) breaks against an earlier one.

    Cases of one run alone fail as ``case_set``; where the sources differ nothing else is judged. A lossless case has no PSNR and
    counts as 999 dB, a missing SSIM as 1, and so does a value of 0. Times are judged together, by the geometric mean over the cases of both runs.
    """
    names = ("source_hash", "bytes", "psnr_db", "ssim", "encode_s", "decode_s")
    side = lambda df, p: df.select("case_id", *(F.col(c).alias(f"{p}_{c}") for c in names), F.lit(True).alias(p))
    j = side(base, "b").join(side(head, "h"), "case_id", "full_outer")
    both = F.col("b").isNotNull() & F.col("h").isNotNull()
    filled = lambda c, v: F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(v)).otherwise(F.col(c))
    rate = F.col("h_bytes") / F.col("b_bytes")
    psnr, ssim = filled("h_psnr_db", 999.0) - filled("b_psnr_db", 999.0), filled("h_ssim", 1.0) - filled("b_ssim", 1.0)
    same = both & (F.col("b_source_hash") == F.col("h_source_hash"))
    rules = {
        "case_set": ~both,
        "source_hash": both & (F.col("b_source_hash") != F.col("h_source_hash")),
        "larger": same & (rate > LARGER) & (psnr < GAIN_PSNR) & (ssim < GAIN_SSIM),
        "psnr": same & (psnr < LOSS_PSNR) & (rate > SMALLER),
        "ssim": same & (ssim < LOSS_SSIM) & (rate > SMALLER),
    }
    timed = {k: F.exp(F.avg(F.when(both & (F.col(f"b_{k}") > 0), F.log(F.col(f"h_{k}") / F.col(f"b_{k}"))))) for k in ("encode_s", "decode_s")}
    one = j.agg(*(F.count_if(c).alias(k) for k, c in rules.items()), *(x.alias(k) for k, x in timed.items()))
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(k).alias("rule"), F.col(k).alias("cases"), none.alias("ratio")) for k in rules]
    rows += [F.struct(F.lit(k).alias("rule"), F.when(F.col(k) > SLOWER, 1).otherwise(0).cast("long").alias("cases"), F.round(k, 6).alias("ratio")) for k in timed]
    return one.select(F.inline(F.array(*rows)))


def run_compare(spark, sf):
    """Two runs derived from events, held against each other by ``gate``."""
    e = read(spark, sf, "events").withColumn("case_id", F.col("user_id") * 10 + F.length("event_type"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")

    def run(which: Column, change: int) -> DataFrame:
        g = e.where(which).groupBy("case_id").agg(F.sum(F.floor(F.col("value") * 100)).alias("bytes"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
        psnr = F.when(F.col("n") % 5 != 0, 30 + F.col("ids") % 40 / 16)
        ssim = F.when(F.col("n") % 7 != 0, 0.9 + F.col("ids") % 32 / 1024)
        return g.select("case_id", (F.col("case_id") + F.when(F.col("case_id") % 6 == 0, change).otherwise(0)).alias("source_hash"), "bytes", psnr.alias("psnr_db"), ssim.alias("ssim"), F.col("n").cast("double").alias("encode_s"), (F.col("bytes") % 50).cast("double").alias("decode_s"))

    return gate(run(early, 0), run(~early, 1))


_RUN = "SELECT user_id * 10 + length(event_type) AS case_id, sum(CAST(floor(value * 100) AS BIGINT)) AS bytes, count(*) AS n, sum(event_id) AS ids FROM events WHERE ts {} TIMESTAMP '2024-01-16' GROUP BY 1"
_SIDE = "SELECT case_id, case_id + CASE WHEN case_id % 6 = 0 THEN {1} ELSE 0 END AS src, bytes, CASE WHEN n % 5 <> 0 THEN 30 + CAST(ids % 40 AS DOUBLE) / 16 ELSE 999 END AS psnr, CASE WHEN n % 7 <> 0 THEN 0.9::DOUBLE + CAST(ids % 32 AS DOUBLE) / 1024 ELSE 1 END AS ssim, CAST(n AS DOUBLE) AS enc, CAST(bytes % 50 AS DOUBLE) AS dec FROM ({0})"
RUN_COMPARE = f"""WITH b AS ({_SIDE.format(_RUN.format("<"), 0)}), h AS ({_SIDE.format(_RUN.format(">="), 1)}),
j AS (SELECT b.case_id IS NOT NULL AND h.case_id IS NOT NULL AS both_runs, b.src = h.src AS same, CAST(h.bytes AS DOUBLE) / b.bytes AS rate, h.psnr - b.psnr AS psnr, h.ssim - b.ssim AS ssim, b.enc AS be, h.enc AS he, b.dec AS bd, h.dec AS hd FROM b FULL JOIN h ON b.case_id = h.case_id),
t AS (SELECT exp(avg(ln(he / be)) FILTER (both_runs AND be > 0)) AS enc, exp(avg(CASE WHEN hd = 0 THEN NULL ELSE ln(hd / bd) END) FILTER (both_runs AND bd > 0)) AS dec FROM j)
SELECT 'case_set' AS rule, count(*) FILTER (NOT both_runs) AS cases, CAST(NULL AS DOUBLE) AS ratio FROM j
UNION ALL SELECT 'source_hash', count(*) FILTER (both_runs AND NOT same), NULL FROM j
UNION ALL SELECT 'larger', count(*) FILTER (both_runs AND same AND rate > {LARGER} AND psnr < {GAIN_PSNR} AND ssim < {GAIN_SSIM}), NULL FROM j
UNION ALL SELECT 'psnr', count(*) FILTER (both_runs AND same AND psnr < {LOSS_PSNR} AND rate > {SMALLER}), NULL FROM j
UNION ALL SELECT 'ssim', count(*) FILTER (both_runs AND same AND ssim < {LOSS_SSIM} AND rate > {SMALLER}), NULL FROM j
UNION ALL SELECT 'encode_s', CASE WHEN enc > {SLOWER} THEN 1 ELSE 0 END, round(enc, 6) FROM t UNION ALL SELECT 'decode_s', CASE WHEN dec > {SLOWER} THEN 1 ELSE 0 END, round(dec, 6) FROM t"""


def median_by_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the middle value, or the mean of the two middle ones. Values are counted first, so no group is gathered; nulls do not count."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    c = c.select("*", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    low, high = at(F.floor((F.col("all") - 1) / 2)), at(F.floor(F.col("all") / 2))
    return c.groupBy(group).agg(((low.cast("double") + high.cast("double")) / 2).alias("median"))


def timing_summary(spark, sf):
    """Median of samples, throughput and XOR checksum by case."""
    e = read(spark, sf, "events")
    bytes_ = F.sum(F.octet_length("props").cast("bigint"))
    rest = e.groupBy("user_id").agg(F.bit_xor("event_id").alias("checksum"), F.round(bytes_ / F.sum("value") / 1048576, 9).alias("mib_per_s"))
    return rest.join(median_by_rank(e, "user_id", "value"), "user_id", "left").select("user_id", F.round("median", 6).alias("median"), "checksum", "mib_per_s")


TIMING_SUMMARY = "SELECT user_id, round(median(value), 6) AS median, bit_xor(event_id) AS checksum, round(sum(octet_length(encode(props))) / sum(value) / 1048576, 9) AS mib_per_s FROM events GROUP BY user_id"


def meta_unpack(spark, sf):
    """Bit-packed colour metadata, frame rates and frame durations."""
    k = F.col("l_partkey") * 37 + F.col("l_suppkey")
    n, d = F.shiftright(k, 4) % 120, k % 5
    m = S.meta_fields(k)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m"), n.alias("n"), d.alias("d")).select(
        "l_orderkey", "l_linenumber", *(F.col(f"m.{c}").alias(c) for c in ("matrix", "transfer", "primaries", "full_range", "chroma", "valid")), (F.shiftleft("n", 16) + F.col("d")).alias("packed_fps"), S.frame_ticks(F.when(F.col("n") > 0, F.col("n")), F.col("d")).alias("frame_us"))


META_UNPACK = """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey * 37 + l_suppkey AS k FROM lineitem),
f AS (SELECT *, k & 15 AS matrix, (k >> 4) & 15 AS transfer, (k >> 8) & 15 AS primaries, (k >> 12) & 1 AS full_range, (k >> 13) & 7 AS chroma, (k >> 4) % 120 AS n, k % 5 AS d FROM k)
SELECT l_orderkey, l_linenumber, matrix, transfer, primaries, full_range, chroma, matrix < 4 AND transfer < 5 AND primaries < 4 AND chroma < 3 AND k >> 16 = 0 AS valid, (n << 16) + d AS packed_fps,
CASE WHEN n > 0 AND 1000000 * d // n > 0 THEN 1000000 * d // n END AS frame_us FROM f"""


def counted_bytes(batches):
    """(symbol, n) of all bytes in a column of texts, one batch a task; counted a MB at a time, as counting takes eight bytes for each."""
    total = np.zeros(256, np.int64)
    for b in batches:
        t = b.column(0)
        if t.buffers()[2] is None:
            continue
        at = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1]
        raw = np.frombuffer(t.buffers()[2], np.uint8)[at[0] : at[-1]]
        for lo in range(0, len(raw), 1 << 20):
            total += np.bincount(raw[lo : lo + (1 << 20)], minlength=256)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["symbol", "n"])
    give_back()


def byte_histogram(spark, sf):
    """Bytes of all texts: each task counts its own and sends at most 256 rows; Arrow batches are bounded by bytes, not by rows alone."""
    bounded_batches(spark)
    texts = read(spark, sf, "documents").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
    return texts.mapInArrow(counted_bytes, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


_HIST = "hist AS (SELECT CAST(('0x' || b) AS BIGINT) AS symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1)"
BYTE_HISTOGRAM = f"WITH {_HIST} SELECT symbol, n FROM hist"


def freq_normalize(spark, sf):
    """Counts scaled to 4096 by floors of at least one, the rest to the largest remainders (the higher symbol among equals), and the running sum."""
    w = Window.partitionBy(F.lit(0))  # at most 256 rows
    h = byte_histogram(spark, sf).withColumn("all", F.sum("n").over(w))
    h = h.select("symbol", "n", F.greatest(F.floor(F.col("n") * 4096 / F.col("all")), F.lit(1)).alias("f"), (F.col("n") * 4096 % F.col("all")).alias("rest"))
    h = h.select("*", (4096 - F.sum("f").over(w)).alias("left"), F.row_number().over(w.orderBy(F.desc("rest"), F.desc("symbol"))).alias("k"), F.row_number().over(w.orderBy(F.desc("n"), F.desc("symbol"))).alias("top"))
    h = h.select("symbol", (F.col("f") + F.when((F.col("left") > 0) & (F.col("k") <= F.col("left")), 1).when((F.col("left") < 0) & (F.col("top") == 1), F.col("left")).otherwise(0)).cast("bigint").alias("freq"))
    return h.select("symbol", "freq", (F.sum("freq").over(w.orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)) - F.col("freq")).alias("start"), (F.sum("freq").over(w) == 4096).alias("valid"))


FREQ_NORMALIZE = f"""WITH {_HIST}, s AS (SELECT symbol, n, greatest(n * 4096 // sum(n) OVER (), 1) AS f, n * 4096 % sum(n) OVER () AS rest FROM hist),
k AS (SELECT *, 4096 - sum(f) OVER () AS rem, row_number() OVER (ORDER BY rest DESC, symbol DESC) AS k, row_number() OVER (ORDER BY n DESC, symbol DESC) AS top FROM s),
f AS (SELECT symbol, CAST(f + CASE WHEN rem > 0 AND k <= rem THEN 1 WHEN rem < 0 AND top = 1 THEN rem ELSE 0 END AS BIGINT) AS freq FROM k)
SELECT symbol, freq, CAST(sum(freq) OVER (ORDER BY symbol) - freq AS BIGINT) AS start, sum(freq) OVER () = 4096 AS valid FROM f"""


def _repeated(d: DataFrame, *keys: str) -> DataFrame:
    """Rows whose text has a hash that another row with the same keys has too: only these are compared as texts."""
    hashed = d.withColumn("h", F.xxhash64("text"))
    again = hashed.groupBy(*keys, "h").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return hashed.join(again, [*keys, "h"], "left_semi")


def dup_blocks(spark, sf):
    """The first earlier document with the same bytes: by hash, then by text among those whose hash repeats; minima are taken before the shuffle."""
    d = _repeated(read(spark, sf, "documents").select("doc_id", "text"))
    first = d.groupBy("h", "text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, ["h", "text"]).where("doc_id > first_id").select("doc_id", "first_id")


DUP_BLOCKS = "WITH f AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) SELECT doc_id, first_id FROM documents JOIN f USING (text) WHERE doc_id > first_id"


def repeated_block_pct(spark, sf):
    """Share of a source's documents that repeat an earlier one; texts are shuffled only where a hash repeats."""
    d = read(spark, sf, "documents").select("source", "text")
    extra = _repeated(d, "source").groupBy("source", "h", "text").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("extra"))
    return d.groupBy("source").agg(F.count("*").alias("rows")).join(extra, "source", "left").select("source", F.round(100.0 * F.coalesce("extra", F.lit(0)) / F.col("rows"), 6).alias("percent"))


REPEATED_BLOCK_PCT = "WITH d AS (SELECT source, text, count(*) AS n FROM documents GROUP BY ALL) SELECT source, round(100.0::DOUBLE * sum(n - 1) / sum(n), 6) AS percent FROM d GROUP BY source"


def modal_vector(spark, sf):
    """The most frequent vector of a group of blocks; among equals the one of smaller magnitude, then smaller value."""
    v = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3 - 1).alias("dx"), (F.col("l_suppkey") % 3 - 1).alias("dy"))
    c = v.groupBy("l_orderkey", "dx", "dy").agg(F.count("*").alias("n"))
    key = F.struct((-F.col("n")).alias("a"), (F.abs("dx") + F.abs("dy")).alias("b"), "dx", "dy")
    return c.groupBy("l_orderkey").agg(F.min(key).alias("k")).select("l_orderkey", F.col("k.dx").alias("dx"), F.col("k.dy").alias("dy"), (-F.col("k.a")).alias("n"))


MODAL_VECTOR = """WITH c AS (SELECT l_orderkey, l_partkey % 3 - 1 AS dx, l_suppkey % 3 - 1 AS dy, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, dx, dy, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, abs(dx) + abs(dy), dx, dy) = 1"""


def used_references(spark, sf):
    """References that any plane of a frame uses, renumbered densely."""
    u = read(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("ref")).agg(F.bool_or(F.col("l_linenumber") % 2 == 1).alias("used"))
    return u.where("used").select("l_orderkey", "ref", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ref")) - 1).cast("bigint").alias("place"))


USED_REFERENCES = """WITH u AS (SELECT l_orderkey, l_suppkey % 4 AS ref, bool_or(l_linenumber % 2 = 1) AS used FROM lineitem GROUP BY ALL)
SELECT l_orderkey, ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY ref) - 1 AS place FROM u WHERE used"""


def rate_curve(spark, sf):
    """Rate and quality by source and setting."""
    e = read(spark, sf, "lineitem")
    return e.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("points"), F.round(F.avg("l_quantity"), 6).alias("mean_bytes"), F.round(F.max("l_extendedprice"), 6).alias("best"))


RATE_CURVE = "SELECT l_returnflag, l_linestatus, count(*) AS points, round(avg(l_quantity), 6) AS mean_bytes, round(max(l_extendedprice), 6) AS best FROM lineitem GROUP BY ALL"


def log_tail(spark, sf):
    """The last 160 events: a bounded report."""
    return packets(spark, sf).orderBy(F.desc("pts"), F.desc("seq")).limit(160).select("seq", "pts")


LOG_TAIL = f"WITH {PACKETS} SELECT seq, pts FROM packets ORDER BY pts DESC, seq DESC LIMIT 160"


def first_seconds(spark, sf):
    """Packets of each stream's first ten days."""
    p = packets(spark, sf).withColumn("start", F.min("pts").over(Window.partitionBy("stream_id")))
    return p.where(F.col("pts") < F.col("start") + 864_000_000_000).groupBy("stream_id").agg(F.count("*").alias("n"))


FIRST_SECONDS = f"WITH {PACKETS}, p AS (SELECT *, min(pts) OVER (PARTITION BY stream_id) AS start FROM packets) SELECT stream_id, count(*) AS n FROM p WHERE pts < start + 864000000000 GROUP BY stream_id"


def limit_violations(spark, sf):
    """Packets above a size limit and kinds that are unknown, as rows of rules."""
    p = packets(spark, sf)
    rules = {"packet_too_large": F.col("payload_len") > 9, "unknown_kind": F.col("kind") > 3, "odd_stream_video": (F.col("kind") == 2) & (F.col("stream_id") % 2 == 1)}
    hit = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return p.select("seq", F.explode(hit).alias("rule"))


LIMIT_VIOLATIONS = f"""WITH {PACKETS} SELECT seq, 'packet_too_large' AS rule FROM packets WHERE payload_len > 9 UNION ALL SELECT seq, 'unknown_kind' FROM packets WHERE kind > 3
UNION ALL SELECT seq, 'odd_stream_video' FROM packets WHERE kind = 2 AND stream_id % 2 = 1"""


def rising_indexes(spark, sf):
    """Whether an order's part keys rise strictly, as coefficient indexes must."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    r = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") > F.lag("l_partkey").over(w)).alias("up"))
    return r.groupBy("l_orderkey").agg(F.coalesce(F.every("up"), F.lit(True)).alias("rising"))


RISING_INDEXES = """WITH r AS (SELECT l_orderkey, l_partkey > lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS up FROM lineitem)
SELECT l_orderkey, coalesce(bool_and(up), true) AS rising FROM r GROUP BY l_orderkey"""


def duplicate_ids(spark, sf):
    """Identifiers that a file uses more than once."""
    return packets(spark, sf).groupBy("file_id", "pts").agg(F.count("*").alias("n")).where("n > 1").unionAll(read(spark, sf, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("n")).where("n > 1").select(F.regexp_extract("source", r"\d+", 0).cast("bigint"), F.col("n_chars").cast("bigint"), "n"))


DUPLICATE_IDS = f"""WITH {PACKETS} SELECT file_id, pts, count(*) AS n FROM packets GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT CAST(regexp_extract(source, '\\d+') AS BIGINT), n_chars, count(*) FROM documents GROUP BY source, n_chars HAVING count(*) > 1"""


def color_meta(spark, sf):
    """Packed colour metadata from names, as a probe reports them."""
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    p = read(spark, sf, "lineitem")
    packed = S.color_meta(pick("l_partkey", _MATRIX), pick("l_suppkey", _TRANSFER), pick("l_orderkey", _PRIMARIES), pick("l_partkey", _RANGE), pick("l_suppkey", _PLACE))
    return p.select("l_partkey", "l_suppkey", "l_orderkey", packed.cast("bigint").alias("meta0")).groupBy("meta0").agg(F.count("*").alias("n"))


_MATRIX, _TRANSFER, _PRIMARIES = ("bt709", "smpte170m", "bt2020nc", "bt470bg", "other"), ("bt709", "iec61966-2-1", "smpte2084", "arib-std-b67", "linear"), ("bt2020", "bt709", "bt470bg", "film")
_RANGE, _PLACE = ("pc", "tv", "jpeg"), ("left", "center", "top")
_NAME = lambda c, names: f"[{', '.join(repr(n) for n in names)}][{c} % {len(names)} + 1]"
COLOR_META = f"""WITH n AS (SELECT {_NAME("l_partkey", _MATRIX)} AS m, {_NAME("l_suppkey", _TRANSFER)} AS t, {_NAME("l_orderkey", _PRIMARIES)} AS p, {_NAME("l_partkey", _RANGE)} AS r, {_NAME("l_suppkey", _PLACE)} AS c FROM lineitem)
SELECT CAST(CASE m WHEN 'smpte170m' THEN 1 WHEN 'bt470bg' THEN 1 WHEN 'bt709' THEN 2 WHEN 'bt2020nc' THEN 3 ELSE 0 END + CASE t WHEN 'bt709' THEN 16 WHEN 'iec61966-2-1' THEN 32 WHEN 'smpte2084' THEN 48 WHEN 'arib-std-b67' THEN 64 ELSE 0 END
+ CASE p WHEN 'bt470bg' THEN 256 WHEN 'bt709' THEN 512 WHEN 'bt2020' THEN 768 ELSE 0 END + CASE WHEN r IN ('pc', 'jpeg') THEN 4096 ELSE 0 END + CASE c WHEN 'left' THEN 8192 WHEN 'center' THEN 16384 ELSE 0 END AS BIGINT) AS meta0, count(*) AS n FROM n GROUP BY 1"""


def stream_order(spark, sf):
    """Streams of each file in ascending order of id."""
    s = packets(spark, sf).select("file_id", "stream_id").distinct()
    return s.select("file_id", "stream_id", F.row_number().over(Window.partitionBy("file_id").orderBy("stream_id")).cast("bigint").alias("place"))


STREAM_ORDER = f"WITH {PACKETS} SELECT file_id, stream_id, row_number() OVER (PARTITION BY file_id ORDER BY stream_id) AS place FROM (SELECT DISTINCT file_id, stream_id FROM packets)"

_ALL = (verify_counts, packet_interleave, route_lookup, orphan_packets, epoch_fixed, epoch_scene_cut, audio_epochs, front_offsets, packet_offsets, seek_epoch, reindex_groups, media_before_epoch, ref_window, missing_dependencies, range_violations, unique_stream, trim_audio, audio_to_epoch, nearest_rank_pct, run_compare, timing_summary, meta_unpack, byte_histogram, freq_normalize, dup_blocks, repeated_block_pct, modal_vector, used_references, rate_curve, log_tail, first_seconds, limit_violations, rising_indexes, duplicate_ids, stream_order, color_meta)
QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in _ALL}
