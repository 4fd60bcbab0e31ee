"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

Lines without text are passed over. A rolling hash over the hashes of the last WINDOW lines (60
bits of MD5 each, the older one shifted, joined by exclusive or) closes a chunk wherever it is 0
modulo DIVISOR, so an inserted or removed line moves boundaries near it only. Text also bounds
chunks by its amount: a line whose hash modulo SPAN is below its length in characters stands
alone, so the longer a line, the likelier it is a chunk of its own. Chunks that occur more than
once in the corpus are the seeds; the windows of two neighbouring lines, compared in the same
way, extend them to the whole run of repeated lines, whatever the chunks at its ends hold
besides. Chunks and windows are told by the hashes of all their lines, and lines that share a hash are
compared byte for byte, so what goes has been compared whole. Of each repeated chunk or window all but the
first occurrence go. The first line of its kind in the corpus therefore always stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import meet
from .store import Workspace

WINDOW, DIVISOR, SPAN = 2, 4, 256
#: Bytes up to which a side is broadcast; beyond it the join is by shuffle.
BROADCAST = 64 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def units(text: Column) -> Column:
    """Array of (a, b, x): first and last line, from 0, and the line hashes of each chunk and each window of two lines with text."""

    def of(ls: Column) -> Column:
        n = F.size(ls)
        h = lambda k: F.get(ls, k)["h"]
        alone = lambda k: F.coalesce(F.get(ls, k)["alone"], F.lit(False))

        def closes(k: Column) -> Column:
            roll = h(k)
            for back in range(1, WINDOW):
                roll = roll.bitwiseXOR(F.coalesce(F.shiftright(h(k - back), back), F.lit(0).cast("bigint")))
            return (k == n - 1) | (F.pmod(roll, F.lit(DIVISOR)) == 0) | alone(k) | alone(k + 1)

        def unit(first: Column, last: Column) -> Column:
            own = F.transform(F.slice(ls, first + 1, last - first + 1), lambda x: x["h"])
            return F.struct(F.get(ls, first)["i"].alias("a"), F.get(ls, last)["i"].alias("b"), own.alias("x"))

        def of_ends(ends: Column) -> Column:
            spans = F.transform(ends, lambda last, k: F.struct(F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).alias("first"), last.alias("last")))
            seeds = F.filter(spans, lambda s: (s["last"] > s["first"] + 1) | ((s["last"] == s["first"]) & alone(s["first"])))  # two lines are a window anyway
            return F.concat(F.transform(seeds, lambda s: unit(s["first"], s["last"])), windows)

        windows = F.transform(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda k: unit(k, k + 1))
        some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return _let(F.filter(some, closes), of_ends)

    marked = F.transform(split_lines(text), lambda x, i: F.when(F.trim(x) != "", F.struct(i.alias("i"), line_hash(x).alias("h"), F.length(x).alias("n"))))
    kept = F.transform(F.filter(marked, lambda x: x.isNotNull()), lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), (F.pmod(x["h"], F.lit(SPAN)) < x["n"]).alias("alone")))
    return _let(kept, of)


def _sized(ws: Workspace, df: DataFrame, name: str, size: Column) -> tuple[DataFrame, bool]:
    """``df`` saved, and whether its bytes, summed as they are written, allow a broadcast."""
    out, seen = ws.measured(df, name, bytes=F.sum(size.cast("long")))
    return out, seen["bytes"] <= BROADCAST


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated chunks and windows taken out of ``text``, and __n_removed, the number of lines that went.

    The first occurrence (smallest doc_id, nulls first, then text hash, then place in the text) stays. Rows
    that share doc_id and text count as one document and keep the same lines. Null texts stay null.
    Only hashes are written and shuffled, and the lines of repeated units for the comparison of bytes; sides of up to
    BROADCAST bytes are broadcast, so whole texts are shuffled only where more than that is to go.
    """
    ws = Workspace(docs.sparkSession)
    doc = {"__d": F.col("doc_id"), "__h": F.xxhash64(text)}
    each = docs.select(*(c.alias(k) for k, c in doc.items()), F.inline(units(F.col(text)))).select("__d", "__h", "a", "b", "x")
    each, total = ws.measured(each, "units", rows=F.count(F.lit(1)))
    place = F.struct("__d", "__h", "a", "b")
    again = each.groupBy("x").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again, small = _sized(ws, again, "repeated", 64 + 8 * F.size("x"))
    met = each.join(F.broadcast(again.drop("n")), "x") if small else meet(each, again, "x", "n", total["rows"])
    later = met.where(~(F.col("first.__d").eqNullSafe(F.col("__d")) & (F.col("first.__h") == F.col("__h")) & (F.col("first.a") == F.col("a"))))
    spans = later.select("__d", "__h", "a", "b", F.lit(True).alias("goes")).unionAll(again.select("first.*", F.lit(False))).distinct()  # a repeated row has the same spans
    rows = F.flatten(F.collect_list(F.sequence("a", "b")))
    gone = F.flatten(F.collect_list(F.when(F.col("goes"), F.sequence("a", "b"))))
    touched = spans.groupBy("__d", "__h").agg(F.array_distinct(rows).alias("__all"), F.array_distinct(gone).alias("__gone"))
    touched, small = _sized(ws, touched, "touched", 64 + 4 * F.size("__all") + 4 * F.size("__gone"))
    ws.drop("units")

    sent = F.broadcast if small else (lambda df: df)
    keyed = docs.withColumn("__hash", doc["__h"])
    on = lambda right: F.col("doc_id").eqNullSafe(right["__d"]) & (F.col("__hash") == right["__h"])
    side = sent(touched.select("__d", "__h", "__all"))
    lines = keyed.select("doc_id", "__hash", F.col(text).alias("__t")).join(side, on(side)).select("__d", "__h", "__all", split_lines(F.col("__t")).alias("__l"))
    lines = lines.select("__d", "__h", F.explode("__all").alias("__i"), "__l").select("__d", "__h", "__i", F.get("__l", F.col("__i")).alias("line")).withColumn("hash", line_hash(F.col("line")))
    differ = ws.save(lines.groupBy("hash").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("hash"), "differ")
    if differ.limit(1).count():  # lines that only share a hash stay, with what hangs on them
        wrong = lines.join(differ, "hash").groupBy("__d", "__h").agg(F.collect_set("__i").alias("__wrong"))
        touched = touched.join(wrong.select(F.col("__d").alias("d"), F.col("__h").alias("h"), "__wrong"), F.col("__d").eqNullSafe(F.col("d")) & (F.col("__h") == F.col("h")), "left")
        touched = touched.select("__d", "__h", F.array_except("__gone", F.coalesce("__wrong", F.array().cast("array<int>"))).alias("__gone"))
    side = sent(touched.where(F.size("__gone") > 0).select("__d", "__h", "__gone"))
    j = keyed.join(side, on(side), "left")
    left = _let(split_lines(F.col(text)), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i)), "\n"))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(left)
    others = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return j.select(*others, F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("__n_removed"))


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, the remaining text and the number of lines removed, for every document.

    A null text stays null; a text whose lines all go becomes empty. Repeated rows (same
    doc_id, same text) are one document. An empty table gives no rows; extra columns are ignored.
    A very long text is an array of its lines in one task, at a cost in proportion to its length.
    """
    return dedup_lines(docs.select("doc_id", "text")).withColumnRenamed("__n_removed", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The pipeline's form: documents' own columns, n_chars brought up to date; a document that is emptied goes.

    Null texts stay; repeated rows are treated alike; an empty table stays empty.
    """
    out = dedup_lines(docs).where("__n_removed = 0 OR trim(text) != ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = f"""
WITH a AS (SELECT doc_id, i, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
l AS (SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS h FROM a WHERE trim(line) <> ''),
m AS (SELECT *, h % {SPAN} < length(line) AS alone FROM l),
b AS (SELECT *, lag(h) OVER w AS before, lead(alone) OVER w AS nxt, lead(i) OVER w AS j, lead(line) OVER w AS other FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, j IS NULL OR xor(h, coalesce(before >> 1, 0)) % {DIVISOR} = 0 OR alone OR coalesce(nxt, false) AS closes FROM b),
k AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
t AS (SELECT doc_id, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, k HAVING count(*) >= 3 OR (count(*) = 1 AND bool_or(alone))
      UNION ALL SELECT doc_id, i, j, line || chr(10) || other FROM k WHERE j IS NOT NULL),
f AS (SELECT doc_id, a, b FROM t QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1),
g AS (SELECT DISTINCT a.doc_id, i FROM a JOIN f ON a.doc_id = f.doc_id AND i BETWEEN f.a AND f.b),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS text, count(g.i) AS n_removed FROM a LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, o.text, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
