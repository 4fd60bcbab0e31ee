"""Periodic runs of words: stretches that repeat one period at least four times over.

A suffix automaton of the words gives every class of substrings by its end positions. The
sets of end positions are ordered and merged from the longest class to the shortest, the
smaller ones into the largest. A pair of neighbours that a merge has made, no farther apart
than the class's longest substring, is a square: its distance is a period there. Squares of
enough repetitions are extended to both sides as far as the period holds, which are the runs.

Words that provably lie in no run stay out of the automaton: every window of GRAM words within
a run occurs in that run again, so what lies between repeated windows is passed over first.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import binary_text, bounded_batches

#: A run is at least SHORTEST words and TIMES periods long. Windows of GRAM words then occur twice or more in each run.
SHORTEST, TIMES, GRAM = 6, 4, 5
#: Times that stretches are narrowed down; any number is right.
ROUNDS = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a sequence that can hold runs: chains of windows each of which is in its own chain again."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g = g * _ODD + ids[k : n + k]
    at, part = np.arange(n), np.zeros(n, np.uint64)
    for _ in range(ROUNDS):
        key = (g[at] ^ (part * np.uint64(0xD6E8FEB86659FD93))) * _ODD
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.all():
            break
        at = at[again]
        if len(at) < 2:
            return []
        part = np.cumsum(np.diff(at, prepend=at[0]) > 1).astype(np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    last = np.append(first[1:], len(at)) - 1
    return [(b, e + GRAM) for b, e in zip(at[first].tolist(), at[last].tolist(), strict=True) if e > b]


def automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length, suffix link and own end position (-1 for none) of each state; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(seq):
        new = len(to)
        to.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def squares(seq: list[int]):
    """(first, last, period) of squares that neighbouring end positions seed, from the longest class to the shortest; last is included."""
    length, link, end = automaton(seq)
    below: list[list[list[int]] | None] = [None] * len(length)
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        sets, most = below[v] or [], length[v]
        below[v] = None
        if end[v] >= 0:
            sets.append([end[v]])
        big = max(range(len(sets)), key=lambda k: len(sets[k]))
        held = sets.pop(big)
        new = [x for s in sets for x in s]
        if len(new) * 8 > len(held):
            held.extend(new)
            held.sort()
        else:
            for x in new:
                insort(held, x)
        for x in new:  # neighbours are looked at when all ends of the class are there
            k = bisect_left(held, x)
            for a, b in ((held[k - 1], x) if k else (x, x), (x, held[k + 1]) if k + 1 < len(held) else (x, x)):
                d = b - a
                if 0 < d <= most and most + d >= max(SHORTEST, TIMES * d):
                    yield a - most + 1, b, d
        if link[v] > 0:
            if below[link[v]] is None:
                below[link[v]] = []
            below[link[v]].append(held)


def runs_of(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    n = len(seq)
    for a, b, d in squares(seq):
        starts, ends = found.setdefault(d, ([], []))
        k = bisect_right(starts, a) - 1
        if k >= 0 and ends[k] >= b:
            continue
        while a > 0 and seq[a - 1] == seq[a - 1 + d]:
            a -= 1
        while b + 1 < n and seq[b + 1] == seq[b + 1 - d]:
            b += 1
        k = bisect_left(starts, a)
        starts.insert(k, a)
        ends.insert(k, b)
    return sorted((a, b - a + 1, d) for d, (starts, ends) in found.items() for a, b in zip(starts, ends, strict=True))


def runs_in(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words."""
    if len(words) < SHORTEST:
        return []
    out: list[tuple[int, int, int]] = []
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for b, e in stretches(ids):
        own: dict[bytes, int] = {}
        out += [(s + b, length, d) for s, length, d in runs_of([own.setdefault(w, len(own)) for w in words[b:e]])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", words_of: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs by start, then period, and its text without what they repeat.

    Each text is worked on whole in the task that reads it: no shuffle. Null, empty and blank texts have no words and no
    runs. Repeated rows repeat; an empty table gives no rows; extra columns are ignored. A stretch that can hold
    runs takes about a kilobyte a word while its automaton stands. ``words_of`` may change the words of a document first.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            n, found, rest = [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = t.as_py().split()  # bytes split at 0x20 and 0x09 to 0x0D
                if words_of:
                    words = words_of(doc_id, words)
                runs = runs_in(words)
                n.append(len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                rest.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(rest, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text(text).alias("t"))
    return d.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the hash of its id, with a periodic tail; others as they are."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, for every document.

    A null doc_id keeps its words as they are. Ties for the longest run go to the smallest start, then period;
    without runs its four columns are null. Other cases are those of ``periodic_runs``.
    """
    found = periodic_runs(docs, words_of=repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("b", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.l").alias("length"),
        (-F.col("b.q")).alias("period"),
        F.expr("(1000 * b.l) div (-b.q)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
