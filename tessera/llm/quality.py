"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

The sketch is a histogram over integer buckets with 32 steps for each power of two
(relative error below 1/32). Sketches merge by adding counts, so a group's sketch, a
language's and the whole corpus's all come from one small table of counts.

Every signal is a count over an exposure (symbols over characters, ...). A group's fences lie
SPREAD interquartile distances beyond its quartiles; the quartiles are drawn towards the
language's, and these towards the corpus's, with the weight of PRIOR documents, so that a small
group leans on its parent and a large one stands alone, without a step between. A document
goes when even the end of its count's confidence interval that is nearer lies beyond a fence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .segments import give_back
from .store import Workspace, binary_text

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Signal: (count, exposure, scale, words or characters that come as one, whether there is a lower fence too).
SIGNALS = {
    "word_len": ("word_chars", "n_words", 100, 1, True),
    "symbols": ("n_symbols", "word_chars", 10000, 1, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 16, False),  # an 8-word window and its repetition
}
#: Weight of the parent's quartiles, in documents.
PRIOR = 50
#: A fence lies this many times the distance between the quartiles beyond the outer one: up to a quarter of a group may be junk without moving it.
SPREAD = 3
#: Standard errors of a count (the square root of independent units) on either side of it.
SURE = 3


def _repeats(b: W.Block, k: int = 8) -> np.ndarray:
    """Words inside k-word windows that occur at least twice in their text."""
    h, at = b.windows(k)
    doc = np.searchsorted(b.ptr, at, side="right") - 1
    key = W.mix(h + doc.astype(W.U) * W.U(0x9E3779B97F4A7C15))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(b.n, np.int64)
    i = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    first = at[twice[i] == key]
    cover = np.zeros(len(b.word) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[b.ptr[1:]] - covered[b.ptr[:-1]]


def _lines(b: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them equal to an earlier line, of each text."""
    ends = np.unique(np.concatenate([np.flatnonzero(b.raw == 10), b.offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1] + (b.raw[np.minimum(ends[:-1], max(len(b.raw) - 1, 0))] == 10)]) if len(b.raw) else np.zeros(len(ends), np.int64)
    # a text that begins right after a line feed of the previous text still begins a line of its own
    doc = np.searchsorted(b.offsets, starts, side="right") - 1
    has = np.searchsorted(b.start, ends) > np.searchsorted(b.start, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    if not len(starts):
        return np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
    key = W.mix(b.span_hash(starts, ends) + doc.astype(W.U) * W.U(0xA0761D6478BD642F))
    _, first = np.unique(key, return_index=True)
    n = np.bincount(doc, minlength=b.n)
    return n, n - np.bincount(doc[first], minlength=b.n)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The six counts of every text; a null text is empty."""
    out: dict[str, list] = {k: [] for k in STATS}
    for b in W.blocks(texts, lower=False):
        def total(mask: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(mask)])
            return c[b.offsets[1:]] - c[b.offsets[:-1]]

        n_lines, dup = _lines(b)
        for k, v in zip(STATS, (b.n_words, total(~b.space & ((b.raw & 0xC0) != 0x80)), total(W.SYMBOL[b.raw]), n_lines, dup, _repeats(b)), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs and its six counts (long), in one pass over the whole texts."""
    names = [prefix + k for k in STATS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in names)])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            stats = text_stats(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[k], pa.int64()) for k in STATS)], names=[*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, schema)


def bucket(v: F.Column) -> F.Column:
    """Bucket of a non-negative integer: itself below 64, else 32 buckets for each power of two."""
    e = (F.length(F.bin(v)) - 6).cast("int")
    return F.when(v < 64, v).otherwise(e * 32 + F.call_function("shiftright", v, F.greatest(e, F.lit(0)))).cast("long")


def bucket_low(k: F.Column) -> F.Column:
    """The least value of a bucket."""
    e = F.greatest(F.floor(k / 32).cast("int") - 1, F.lit(0))
    return F.when(k < 64, k).otherwise(F.call_function("shiftleft", k - 32 * e, e))


def base_failed(p: str = "") -> F.Column:
    return (F.col(p + "n_words") < 20) | (100 * F.col(p + "n_repeat_words") > 30 * F.col(p + "n_words"))


def _rate(name: str, p: str = "", sure: int = 0) -> str:
    """A signal's scaled integer value, at the lower (-1) or upper (1) end of its count's interval."""
    count, exposure, scale, unit, _ = SIGNALS[name]
    k, e = f"`{p}{count}`", f"greatest(`{p}{exposure}`, 1)"
    margin = f"CAST(floor({SURE} * sqrt(CAST({k} * {unit} AS DOUBLE))) AS BIGINT)"
    return f"({scale} * {k if not sure else f'greatest({k} - {margin}, 0)' if sure < 0 else f'({k} + {margin})'}) div {e}"


def sketches(stats: DataFrame, lang: str = "lang", source: str = "source", p: str = "") -> DataFrame:
    """(lang, source, signal, bucket, n): counts of the documents that pass the base rules."""
    signals = F.array(*(F.struct(F.lit(k).alias("signal"), F.expr(_rate(k, p)).alias("v")) for k in SIGNALS))
    long = stats.where(~base_failed(p)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(signals).alias("s"))
    return long.groupBy("lang", "source", F.col("s.signal").alias("signal"), bucket(F.col("s.v")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, high_*, low_*) of every group, from its quartiles drawn towards its language's and the corpus's."""
    none = F.lit(None).cast("string")
    levels = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none)]
    merged = None
    for k, lang, source in levels:
        part = sketch.groupBy(lang.alias("lang"), source.alias("source"), "signal", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(k))
        merged = part if merged is None else merged.unionByName(part)
    key = ["level", "lang", "source", "signal"]
    w = Window.partitionBy(*key)
    run = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("size", F.sum("n").over(w))

    def quantile(pct: int) -> F.Column:
        return F.min(F.when(100 * F.col("below") >= pct * F.col("size"), bucket_low(F.col("bucket"))))

    q = run.groupBy(*key).agg(F.max("size").alias("size"), quantile(25).alias("q25"), quantile(75).alias("q75"))

    def level(k: int) -> DataFrame:
        return q.where(F.col("level") == k).select("lang", "source", "signal", *(F.col(c).alias(f"{c}_{k}") for c in ("size", "q25", "q75")))

    def drawn(c: str, k: int, parent: F.Column) -> F.Column:
        return F.floor((F.col(f"size_{k}") * F.col(f"{c}_{k}") + PRIOR * parent) / (F.col(f"size_{k}") + PRIOR)).cast("bigint")

    own, langs, whole = level(0), level(1).drop("source").withColumnRenamed("lang", "l1").withColumnRenamed("signal", "s1"), level(2).drop("lang", "source").withColumnRenamed("signal", "s2")
    langs = langs.join(whole, langs.s1 == whole.s2).select("l1", "s1", *(drawn(c, 1, F.col(f"{c}_2")).alias(f"{c}_p") for c in ("q25", "q75")))
    j = own.join(langs, own.lang.eqNullSafe(langs.l1) & (own.signal == langs.s1))
    j = j.select("lang", "source", "signal", *(drawn(c, 0, F.col(f"{c}_p")).alias(c) for c in ("q25", "q75")))
    out, wide = [], SPREAD * (F.col("q75") - F.col("q25"))
    for k, (*_, two) in SIGNALS.items():
        out.append(F.max(F.when(F.col("signal") == k, F.col("q75") + wide)).alias(f"high_{k}"))
        if two:
            out.append(F.max(F.when(F.col("signal") == k, F.col("q25") - wide)).alias(f"low_{k}"))
    return j.groupBy("lang", "source").agg(*out)


def judge(stats: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source", p: str = "", out: str = "kept") -> DataFrame:
    """stats with a boolean column ``out``: passes the base rules and lies within its group's fences.

    Joined on language and source (nulls match nulls): a row for each group, so a hot group is met by
    broadcast or, where groups are very many, by a join that adaptive execution splits.
    """
    names = [c for c in fence.columns if c[:4] in ("high", "low_")]
    own = fence.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.struct(*names).alias("__f"))
    j = stats.join(own, stats[lang].eqNullSafe(F.col("__l")) & stats[source].eqNullSafe(F.col("__s")), "left")
    ok = ~base_failed(p)
    for k, (*_, two) in SIGNALS.items():
        ok = ok & (F.expr(_rate(k, p, -1)) <= F.col(f"__f.high_{k}"))
        if two:
            ok = ok & (F.expr(_rate(k, p, 1)) >= F.col(f"__f.low_{k}"))
    return j.withColumn(out, F.coalesce(ok, F.lit(False))).select(*stats.columns, out)


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and the adaptive verdict of every document.

    Null or empty texts have zero counts and fail. Ties at a fence are kept. Rows that
    repeat are judged alike. Null languages and sources are groups of their own. An empty
    table gives no rows. Extra columns are ignored. A very long text is counted whole in one task.
    """
    ws = Workspace(docs.sparkSession)
    stats = ws.save(with_stats(docs.select("doc_id", "lang", "source", binary_text("text").alias("text"))).drop("text"), "stats")
    fence = ws.save(fences(sketches(stats)), "fences")
    return judge(stats, fence).select("doc_id", *(k for k in STATS if k != "n_lines"), base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; texts are read twice and never shuffled by key.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    ws, p = Workspace(docs.sparkSession), "__q_"
    slim = with_stats(docs.select("lang", "source", binary_text("text").alias("text")), prefix=p).drop("text")
    fence = ws.save(fences(sketches(slim, p=p)), "fences")
    wide = with_stats(docs.withColumn("__q_text", binary_text("text")), "__q_text", p).drop("__q_text")
    return judge(wide, fence, p=p, out="__q_kept").where("__q_kept").select(*docs.columns)


def _sql_rate(name: str, sure: int = 0) -> str:
    return "CAST(" + _rate(name, "", sure).replace("`", "").replace(" div ", " // ") + " AS BIGINT)"


_SQL_FENCES = " AND ".join(
    f"max(CASE WHEN v.signal = '{k}' THEN lo END) <= max(CASE WHEN v.signal = '{k}' THEN q75 + {SPREAD} * (q75 - q25) END)"
    + (f" AND max(CASE WHEN v.signal = '{k}' THEN hi END) >= max(CASE WHEN v.signal = '{k}' THEN q25 - {SPREAD} * (q75 - q25) END)" if two else "")
    for k, (*_, two) in SIGNALS.items()
)
_SQL_SIGNALS = ", ".join(f"struct_pack(signal := '{k}', v := {_sql_rate(k)}, lo := {_sql_rate(k, -1)}, hi := {_sql_rate(k, 1)})" for k in SIGNALS)
_SQL_DRAWN = lambda c, own, parent: f"CAST(floor(CAST({own}.size * {own}.{c} + {PRIOR} * {parent}.{c} AS DOUBLE) / ({own}.size + {PRIOR})) AS BIGINT) AS {c}"
SQL = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
c AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM l),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 7) AS s(k) GROUP BY doc_id),
s AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN r USING (doc_id)),
v AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS b FROM (
  SELECT doc_id, lang, source, unnest([{_SQL_SIGNALS}], recursive := true) FROM s WHERE NOT base_failed)),
k AS (SELECT 0 AS level, lang, source, signal, b FROM v UNION ALL SELECT 1, lang, NULL, signal, b FROM v UNION ALL SELECT 2, NULL, NULL, signal, b FROM v),
m AS (SELECT level, lang, source, signal, b, count(*) AS n FROM k GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY b) AS below, sum(n) OVER (PARTITION BY level, lang, source, signal) AS size FROM m),
q AS (SELECT level, lang, source, signal, max(size) AS size, min(CASE WHEN 100 * below >= 25 * size THEN b END) AS b25, min(CASE WHEN 100 * below >= 75 * size THEN b END) AS b75 FROM o GROUP BY ALL),
f AS (SELECT level, lang, source, signal, size, CASE WHEN b25 < 64 THEN b25 ELSE (b25 - 32 * (b25 // 32 - 1)) << (b25 // 32 - 1) END AS q25, CASE WHEN b75 < 64 THEN b75 ELSE (b75 - 32 * (b75 // 32 - 1)) << (b75 // 32 - 1) END AS q75 FROM q),
fl AS (SELECT a.lang, a.signal, {_SQL_DRAWN("q25", "a", "b")}, {_SQL_DRAWN("q75", "a", "b")} FROM f a JOIN f b USING (signal) WHERE a.level = 1 AND b.level = 2),
fg AS (SELECT a.lang, a.source, a.signal, {_SQL_DRAWN("q25", "a", "b")}, {_SQL_DRAWN("q75", "a", "b")} FROM f a JOIN fl b ON a.signal = b.signal AND a.lang IS NOT DISTINCT FROM b.lang WHERE a.level = 0),
d AS (SELECT v.doc_id, {_SQL_FENCES} AS ok FROM v JOIN fg ON v.signal = fg.signal AND v.lang IS NOT DISTINCT FROM fg.lang AND v.source IS NOT DISTINCT FROM fg.source GROUP BY v.doc_id)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, coalesce(ok, false) AS kept FROM s LEFT JOIN d USING (doc_id)
"""
