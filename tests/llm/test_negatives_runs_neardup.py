import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import neardup, negatives, runs
from tests.conftest import SF

VECTORS = "vec_id long, embedding array<double>, label int, dim string, k int, n string, node string, list int"


# --- op 11


def mined(rows, positives=5, negatives_=3, low=50, high=95):
    """Every pair of rows, in Python's integers."""
    seen = []
    for i, v, label, *_ in rows:
        if i is None or v is None or not v or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))
        if row not in seen:
            seen.append(row)
    out = []
    for i in sorted({r[0] for r in seen if r[0] % 50 == 0}):
        _, label, v = min(r for r in seen if r[0] == i)
        scored = sorted((-sum(a * b for a, b in zip(v, r[2])), r[0], r[1]) for r in seen if r[0] != i and len(r[2]) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(i, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def plain(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rnd.randrange(3), "d", i, "n", "x", 1) for i in range(400)]
    rows += [(i, [1.0] * 6, i % 2, None, None, None, None, None) for i in range(400, 520)]  # ties
    rows += [(600, None, 1), (601, [], 1), (602, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (603, [float("nan")] * 6, 1), (604, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (650, [1.0] * 6, None)]
    rows += [(700, [0.5, 0.5], 1), (701, [0.5, 0.25], 1), (702, [0.5, 0.3], 2), (750, [0.0] * 6, 0), (800, [-1.0] * 6, 1)]
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    rows += rows[:3] + rows[400:402]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_hard_negatives_against_all_pairs(odd_vectors, monkeypatch):
    rows, df = odd_vectors
    want = mined(rows)
    assert len(want) > 60
    assert plain(negatives.op11_hard_negatives(df.repartition(7))) == want
    for name, value in (("BLOCK", 32), ("BLOCKS", 2), ("QUERIES", 3), ("SAMPLE", 50)):
        monkeypatch.setattr(negatives, name, value)  # many shards, blocks of a few rows, a sample of a few
    assert plain(negatives.op11_hard_negatives(df)) == want


def test_hard_negatives_of_hot_rows(spark, monkeypatch):
    """A third of all rows are one vector under one label; blocks stay bounded."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rnd = np.random.default_rng(3)
    rows = [(i, [0.75, 0.5, 0.25], 4) if i % 3 == 0 else (i, rnd.normal(size=3).round(3).tolist(), int(rnd.integers(0, 10))) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert plain(negatives.op11_hard_negatives(df)) == mined(rows)


def test_hard_negatives_beyond_64_bits(spark):
    big = [(i, [1e13 * (i % 5), 3.0 * i, 1e300 if i == 57 else 1.0], i % 2) for i in range(60)]
    got = plain(negatives.op11_hard_negatives(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")))
    assert {r[0] for r in got} <= {0, 50} and all(abs(r[4]) < 2**63 for r in got)


def test_hard_negatives_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = plain(negatives.op11_hard_negatives(spark.read.parquet(f"{SF}/embeddings.parquet")))
    assert got and got == sorted(con.execute(negatives.SQL).fetchall())


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.op11_hard_negatives(none).count() == 0 and neardup.op13_near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (None, [0.0], None)], "vec_id long, embedding array<double>, label int")
    assert negatives.op11_hard_negatives(bad).count() == 0
    assert sorted(map(repr, map(tuple, neardup.op13_near_duplicates(bad).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)"]


def test_visits_skip_and_stop():
    """Blocks whose bound misses the window or falls below the last rank are not multiplied at all."""
    rnd = np.random.default_rng(0)
    parts = [rnd.integers(-3, 4, (40, 4)) + 1000 * np.array(c) for c in ([1, 0, 0, 0], [0, 1, 0, 0], [-1, 0, 0, 0], [0, 0, 1, 0])]
    vec = np.concatenate(parts).astype(np.int64)
    mean = np.array([p.mean(axis=0) for p in parts])
    radius = np.array([np.sqrt(((p - m) ** 2).sum(axis=1).max()) for p, m in zip(parts, mean)])
    shard = {"at": np.arange(0, 161, 40), "vec": vec, "ids": np.arange(160), "labels": np.zeros(160, np.int32), "mean": mean, "radius": radius}
    seen, real = [], negatives.scores
    q = np.array([[1000, 0, 0, 0]])
    try:
        negatives.scores = lambda a, b: seen.append(len(b)) or real(a, b)
        ask = lambda lo, hi: negatives.visit(shard, q, np.array([999]), np.zeros(1, np.int32), np.array([[lo]]), np.array([[hi]]), True, 3)
        best = ask(-negatives.MOST, negatives.MOST)
        assert seen == [40] and best.score[0, 0].tolist() == sorted((vec @ q[0]).tolist(), reverse=True)[:3]
        seen.clear()
        assert (ask(-10_000, 10_000).score > negatives.LEAST).sum() == 3 and seen in ([40], [40, 40])
        seen.clear()
        assert (ask(500_000, 600_000).score > negatives.LEAST).sum() == 0 and not seen
    finally:
        negatives.scores = real


# --- op 12


def all_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rnd = random.Random(2)
    for _ in range(3000):
        k, n = rnd.choice([1, 2, 2, 3, 4]), rnd.randint(0, 60)
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            m, at = [b"%d" % rnd.randrange(k) for _ in range(rnd.randint(1, 6))], rnd.randint(0, len(w))
            w = w[:at] + m * rnd.randint(2, 7) + m[: rnd.randrange(len(m))] + w[at:]
        assert runs.runs_in(w) == all_runs(w)
        assert runs.runs_of([int(x) for x in w]) == all_runs(w)  # the automaton alone, without the narrowing


def digest_rows(rows):
    out = []
    for i, text, *_ in rows:
        w = (text or "").encode()
        for c in b"\t\n\x0b\x0c\r":
            w = w.replace(bytes([c]), b" ")
        w = [x for x in w.split(b" ") if x]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a, n = g % len(w), len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        r = all_runs(w)
        drop = {j for s, n, q in r for j in range(s + q, s + n)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
        out.append((i, len(r), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest(), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in drop)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def repeats(spark, odd):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(300):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 80))]
        m = [rnd.choice(words) for _ in range(rnd.randint(1, 9))]
        at = rnd.randint(0, len(w))
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w[:at] + m * rnd.randint(0, 9) + w[at:])))
    rows += rows[:5]
    return rows


def test_periodic_runs_of_documents(spark, odd, repeats):
    for df in (odd.where("length(text) < 60000 OR text IS NULL"), spark.createDataFrame(repeats, "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = runs.op12_periodic_runs(df)
        assert sorted(map(tuple, got.collect()), key=repr) == digest_rows(rows)
    assert got.where("n_runs > 0").count() > 60


def test_periodic_runs_of_long_texts(spark, odd, none):
    assert runs.op12_periodic_runs(none).count() == 0
    got = runs.periodic_runs(odd.where("doc_id = 9")).first()
    assert got.n_words == 30_000 and [tuple(r) for r in got.runs] == [(0, 30_000, 1)] and got.collapsed == "ab"
    period = [f"x{k}" for k in range(997)]
    long = spark.createDataFrame([(1, " ".join(["head"] + period * 11 + period[:5] + ["tail"]))], "doc_id long, text string")
    got = runs.periodic_runs(long).first()
    assert [tuple(r) for r in got.runs] == [(1, 997 * 11 + 5, 997)] and got.collapsed == " ".join(["head", *period, "tail"])


def test_periodic_runs_of_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in ((r.doc_id, r.text) for r in docs.collect()) if len((r[1] or "").split()) < 600]
    want = {r[0]: r for r in digest_rows(rows)}
    got = {r.doc_id: tuple(r) for r in runs.op12_periodic_runs(docs).collect()}
    assert len(got) == docs.count() and all(got[i] == w for i, w in want.items())


# --- op 13


def linked(rows, cosine=0.95):
    use = [k for k, (_, v, *_) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64) / np.abs(rows[k][1]).max()) / np.abs(rows[k][1]).max() for k in use}
    near = {k: [j for j in use if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in use}
    group = {}
    for k in range(len(rows)):
        if k in group:
            continue
        todo, own = [k], {k}
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in own:
                    own.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in own if rows[j][0] is not None]
        group |= {j: min(ids, default=None) for j in own}
    return sorted(((rows[k][0], len(near.get(k, [])), group[k], rows[k][0] == group[k]) for k in range(len(rows))), key=repr)


def groups(seed=4, n=300):
    """Lone vectors, tight and loose groups, chains, copies, and scales apart."""
    rnd = np.random.default_rng(seed)
    rows = [rnd.normal(size=16) for _ in range(n)]
    for size, spread in ((120, 0.05), (150, 0.2), (40, 0.28), (2, 0.1), (3, 0.1)):
        c = rnd.normal(size=16)
        rows += [(c + spread * rnd.normal(size=16)) * 10.0 ** rnd.integers(-3, 4) for _ in range(size)]
    a, b = np.eye(16)[0], np.eye(16)[1]
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 6, 0.1)]  # a ring of links
    rows += [rows[0]] * 30 + [3 * rows[0]]
    order = rnd.permutation(len(rows))
    return [(int(i), rows[k].tolist()) for i, k in enumerate(order)]


def test_near_duplicates_against_all_pairs(spark):
    rows = groups()
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16), (None, rows[0][1]), (None, [5.0] + [0.0] * 15), (9005, [1.0, 2.0]), (9006, [1.0, 2.01]), rows[3], rows[3]]
    rows += [(9007, [1e200 * x for x in rows[7][1]]), (9008, [1e-200 * x for x in rows[7][1]])]
    df = spark.createDataFrame([(*r, "k", 1, "node") for r in rows], "vec_id long, embedding array<double>, k string, n int, node string")
    want = linked(rows)
    for tile in (neardup.TILE, 25):  # 25: components of many tiles
        got = neardup.near_duplicates(df.repartition(5), tile=tile)
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.vec_id == r.component_id) for r in got.collect()), key=repr)
        assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
        assert [g[:3] for g in got if g[0] is None] == [w[:3] for w in want if w[0] is None]


def test_near_duplicates_over_blocks(spark, monkeypatch):
    """Windows that cross blocks and ranges, and more vectors than a window holds."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "WINDOW", 16)
    rows = groups(seed=8, n=2000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    want = {w[0]: w for w in linked(rows)}
    got = {r.vec_id: tuple(r) for r in neardup.op13_near_duplicates(df).collect()}
    assert all(g[1] <= want[i][1] and g[2] >= want[i][2] for i, g in got.items())  # never a link too many
    assert sum(g[1] for g in got.values()) >= 0.9 * sum(w[1] for w in want.values())


def test_near_duplicates_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = neardup.op13_near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(neardup.SQL).fetchall())


def test_passes_grow_with_the_table():
    assert neardup.passes(0, 0.95) == neardup.passes(64, 0.95) == neardup.LEAST
    assert neardup.LEAST < neardup.passes(50_000, 0.95) < neardup.passes(10**9, 0.95) < 100
