import base64
import hashlib
import pathlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, jaccard, lines, packing
from tessera.llm.store import CLEANUP, Workspace, shared_dir
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """Brute force over all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d is not None, d or 0), len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets))


def got_groups(docs):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.op5_ngram_jaccard(docs).collect())


@pytest.mark.parametrize("which", ["odd", "real"])
def test_jaccard(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    assert got_groups(docs) == groups([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_chains_and_thresholds(spark):
    """Families that drift word by word, so that many pairs lie near 0.8 on either side, and shared passages."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 90))]
        for _ in range(12):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            texts.append(" ".join(base))
            if rng.random() < 0.3:
                texts.append(" ".join(base[: len(base) // 2] + passage + base[len(base) // 2 :]))
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(k)]) for k in range(0, 120, 2)]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, old = groups(rows), (jaccard.FREQUENT, jaccard.LARGE, jaccard.TILE, jaccard.SIDE)
    try:
        for jaccard.FREQUENT, jaccard.LARGE, jaccard.TILE, jaccard.SIDE in (old, (3, 32, 256, 4), (40, 2, 4, 2)):
            assert got_groups(docs) == want
    finally:
        jaccard.FREQUENT, jaccard.LARGE, jaccard.TILE, jaccard.SIDE = old


def test_jaccard_kernels():
    rng = random.Random(3)
    for _ in range(300):
        u = [rng.getrandbits(64) for _ in range(rng.randint(1, 80))]
        a, b = set(rng.sample(u, rng.randint(1, len(u)))), set(rng.sample(u, rng.randint(1, len(u))))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert jaccard.overlap_bound(jaccard.signature(x), jaccard.signature(y), len(a), len(b)) >= len(a & b)
        if 100 * len(a & b) >= 80 * len(a | b):
            p, q = sorted(a)[: jaccard.prefix_length(np.array(len(a)))], sorted(b)[: jaccard.prefix_length(np.array(len(b)))]
            common = set(p) & set(q)
            assert common
            t = min(common)
            lo, hi = sorted(((len(a), p.index(t)), (len(b), q.index(t))))
            assert jaccard.enough(lo[0], hi[0], lo[1], hi[1])


def shuffle_files(spark):
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")))


def test_written_rows_leave_no_shuffle_behind(spark):
    before, ws, setting = shuffle_files(spark), Workspace(spark), spark.conf.get(CLEANUP, "false")
    twice = spark.range(5000).selectExpr("id % 700 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"))
    kept = [ws.save(twice, "sums"), ws.save(twice.join(twice.withColumnRenamed("s", "t"), "k"), "both")]  # the same frame is planned anew
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert [x.count() for x in kept] == [700, 700] and twice.count() == 700
    assert spark.conf.get(CLEANUP, "false") == setting


def test_join_drops_what_its_rows_do_not_read(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard, "Workspace", lambda s: made.append(Workspace(s)) or made[-1])
    monkeypatch.setattr(jaccard, "LARGE", 3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(60)]
    jaccard.op5_ngram_jaccard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    left = {p.name for p in pathlib.Path(made[0].root.removeprefix("file://")).iterdir()}
    assert {"sets", "node-components"} <= left
    assert not left & {"nodes", "shared", "labelled", "mixed", "members", "tile-members", "tile-tiles", "tile-links", "chain-likely", "rest-likely"}


@pytest.mark.parametrize("side", [1, 2, 3])
def test_cells_hold_every_pair_of_tiles(spark, monkeypatch, side):
    """Groups of many tiles in adjacent bands, without chains: all links come from the cells."""
    for name, value in (("TILE", 4), ("SIDE", side)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(side)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        t = words[: rng.choice([60, 66, 72, 80, 90])]
        for j in rng.sample(range(len(t)), rng.choice([0, 1, 2])):
            t = [*t[:j], f"x{i}", *t[j + 1 :]]
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("t"), F.lit(0).cast("long").alias("h"))
    ws = Workspace(spark)
    sets = ws.save(jaccard.set_table(docs), "sets")
    nodes = ws.save(sets.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    members = nodes.select("fp", "n", F.col("fp").alias("label"))
    monkeypatch.setattr(ws, "drop", lambda *names: None)
    links = jaccard.Verifier(ws, docs, nodes).tile_links(members, nodes.select(F.col("fp").alias("node"), F.lit(7).cast("long").alias("component")), "tile")
    id_of = {r.fp: r.doc_id for r in nodes.collect()}
    found = components.components(ws, links, "a", "b", "cc").collect()
    least = {}
    for r in found:
        least[r.component] = min(least.get(r.component, 99), id_of[r.node])
    got = {id_of[r.node]: least[r.component] for r in found}
    rep = {r.doc_id: id_of[r.fp] for r in sets.collect()}
    assert {d: got.get(rep[d], rep[d]) for d, _ in rows} == {d: c for (_, d), _, c in groups(rows)}
    assert ws.spark.read.parquet(f"{ws.root}/tile-counts").agg(F.max("tiles")).first()[0] > 3


def test_every_frequent_token_comes_last(spark):
    """Documents of a common line and words of their own meet in no token: all the line's tokens are counted, whatever their hash."""
    line, own = " ".join(f"w{i}" for i in range(30)), lambda k: " ".join(f"x{k}y{i}" for i in range(10))
    docs = spark.createDataFrame([(f"{line} {own(k)}",) for k in range(jaccard.FREQUENT + 5)], "text string").select(F.col("text").cast("binary").alias("t"))
    frequent = jaccard.frequent_tokens(Workspace(spark), docs, 4, 4)
    assert len(frequent) == 26
    assert jaccard.shared_tokens(docs, frequent, 4, 4).count() == 0


def test_cells_in_rounds(spark, monkeypatch):
    """A grid that sends more than a round may is dealt in several, with the same links."""
    made = []
    monkeypatch.setattr(jaccard, "Workspace", lambda s: made.append(Workspace(s)) or made[-1])
    monkeypatch.setattr(Workspace, "drop", lambda *names: None)
    monkeypatch.setattr(jaccard, "input_bytes", lambda df: 0)
    for name, value in (("FREQUENT", 3), ("LARGE", 3), ("TILE", 4), ("SIDE", 1), ("ROUND_BYTES", 100_000)):
        monkeypatch.setattr(jaccard, name, value)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join([*words[: i % 90], f"x{i}", *words[i % 90 + 1 :]])) for i in range(40)]
    rows += [(i, " ".join(words[: 60 + i % 12] + [f"y{i}z{k}" for k in range(7)])) for i in range(40, 70)]
    got = {r.doc_id: r.component_id for r in jaccard.op5_ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for (_, d), _, c in groups(rows)}
    assert len(list(pathlib.Path(made[0].root.removeprefix("file://"), "tile-links").iterdir())) > 1


def test_one_of_each(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {c for (_, d), _, c in groups([(r.doc_id, r.text) for r in docs.collect()])}
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert jaccard.op5_ngram_jaccard(none).count() == jaccard.one_of_each(none).count() == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Exactly one row of each component stays, and no text goes for sharing an id or having none."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [
        (None, text("a") + " more"), (1, text("a")),  # a copy without an id goes
        (None, text("b")), (None, text("c")),  # clean ones without an id stay
        (None, text("d")), (None, text("d")), (None, text("d") + " more"),  # one of the copies without ids stays
        (2, text("e")), (2, text("f")), (3, text("f")),  # texts under one id
        (4, text("g")), (5, text("g")), (5, text("h")),  # an id loses its copied text only
        (6, text("i")), (6, text("i")), (6, text("j")),  # a repeated row stays once
        (None, ""), (None, ""), (None, None), (7, " "), (7, " "),
    ]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)
    out = jaccard.one_of_each(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and sum((t or "").startswith("d0 ") for _, t in got) == 1
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("e")), (2, text("f")), (4, text("g")), (5, text("h")), (6, text("i")), (6, text("j")), (None, ""), (None, ""), (None, None), (7, " ")]
    assert sorted(map(repr, (x for x in got if not (x[1] or "").startswith("d0 ")))) == sorted(map(repr, want))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(7, None), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(Workspace(spark), df, "a", "b").collect()}
    at = {}
    for a, b in edges:
        if b is not None and a != b:
            ca, cb = at.get(a, {a}), at.get(b, {b})
            c = ca | cb
            for x in c:
                at[x] = c
    assert got == {x: min(c) for x, c in at.items()}


def test_components_of_a_hub(spark):
    """100,000 aliases of one node and a second hub that meets it: their edges meet the hub's least neighbour without a shuffle on the hub."""
    from pyspark.sql import functions as F

    star = spark.range(100_000).select((F.col("id") + 10).alias("a"), F.lit(5).cast("long").alias("b"))
    more = spark.range(3000).select((F.col("id") + 200_000).alias("a"), F.lit(199_999).cast("long").alias("b"))
    df = star.unionAll(more).unionAll(spark.createDataFrame([(199_999, 77_777)], "a long, b long"))
    got = components.components(Workspace(spark), df, "a", "b")
    assert got.count() == 100_000 + 3000 + 2 and [r.component for r in got.select("component").distinct().collect()] == [5]


def test_hot_keys_meet_by_broadcast(spark):
    from pyspark.sql import functions as F

    many = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = components.meet(many, one, "k", "n", 3000)
    assert sorted(map(tuple, got.select("k", "id", "top").collect())) == sorted((1 if i < 2000 else i, i, 1999 if i < 2000 else i) for i in range(3000))


def spark_hash(s):
    h = xxhash.xxh64_intdigest(s.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def py_units(text):
    """(first line, last line, text) of the chunks and windows of a text."""
    ls = [(i, x, int(hashlib.md5(x.encode()).hexdigest()[:15], 16)) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
    alone = [h % lines.SPAN < len(x) for _, x, h in ls]
    out, start = [], 0
    for k, (_, _, h) in enumerate(ls):
        r = h ^ (ls[k - 1][2] >> 1 if k else 0)
        if k + 1 == len(ls) or r % lines.DIVISOR == 0 or alone[k] or alone[k + 1]:
            if k - start >= 2 or (k == start and alone[k]):
                out.append((start, k))
            start = k + 1
    out += [(k, k + 1) for k in range(len(ls) - 1)]
    return [(ls[p][0], ls[q][0], "\n".join(x for _, x, _ in ls[p : q + 1])) for p, q in out]


def py_dedup(rows):
    """{(doc_id, text): new text}; rows that are equal are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    seen, out = {}, {}
    for d, t in docs:
        for a, b, x in sorted(py_units(t)):
            seen.setdefault(x, (d, t, a))
    for d, t in docs:
        gone = {i for a, b, x in py_units(t) if seen[x] != (d, t, a) for i in range(a, b + 1)}
        out[d, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_line_dedup(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = py_dedup([r for r in rows if r[1] is not None])
    got = [(r.doc_id, r.text) for r in lines.op9_line_dedup(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, want[d, t] if t is not None else None)) for d, t in rows)


def test_line_dedup_shifts(spark, none):
    """A shared run of lines goes whole wherever it stands; lines that share nothing with a neighbour stay; the pipeline drops emptied documents."""
    rng = random.Random(2)
    line = lambda n=8: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    run, short = [line() for _ in range(40)], [line(4) for _ in range(3)]
    long = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    texts = ["\n".join([line() for _ in range(k)] + run + [line() for _ in range(3)]) for k in range(6)]
    texts += [f"{line()}\n{long}\n{line()}", f"{line()}\n{long}", "x\nown " + line(), "x\nmine " + line(), long]
    texts += ["\n\n".join([line(), *short, line()]), "\n".join([line(), line(), *short, line()])]
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, extra string")
    got = {r.doc_id: r.text for r in lines.op9_line_dedup(docs).collect()}
    assert all(got[i] == texts[i] for i in (0, 6, 8, 9, 11))
    for k in range(1, 6):
        assert got[k].split("\n") == [x for x in texts[k].split("\n") if x not in run]
    assert got[7] == texts[7].split("\n")[0] and got[10] == "" and got[12].split("\n") == [x for x in texts[12].split("\n") if x not in short]
    kept = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    assert 10 not in kept and kept[7].n_chars == len(kept[7].text) and set(kept) == set(range(13)) - {10}
    assert lines.op9_line_dedup(none).count() == 0 and lines.without_repeats(none).columns == none.columns


@pytest.mark.parametrize("values", [2, 37])
def test_line_dedup_compares_bytes(spark, monkeypatch, values):
    """With a hash that many lines share, nothing goes whose bytes do not stand elsewhere."""
    monkeypatch.setattr(lines, "line_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(values)))
    rng = random.Random(9)
    texts = ["\n".join(f"line {rng.randrange(200)} of all" for _ in range(12)) for _ in range(60)]
    got = {r.doc_id: r.text for r in lines.op9_line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    left = {x for t in got.values() for x in t.split("\n")}
    assert left >= {x for t in texts for x in t.split("\n")}


def test_line_dedup_of_repeated_rows(spark, monkeypatch):
    """A row repeated often is one document, whether sides are broadcast or shuffled."""
    text = "\n".join(f"line {i} of a text that one row holds again and again" for i in range(50))
    other = "\n".join(["own line"] + text.split("\n")[10:20])
    df = spark.range(20_002).selectExpr("CASE id WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS doc_id", f"CASE WHEN id = 1 THEN '{other}' ELSE '{text}' END AS text")
    for most in (lines.BROADCAST, 0):
        monkeypatch.setattr(lines, "BROADCAST", most)
        got = {(r.doc_id, r.text): r["count"] for r in lines.op9_line_dedup(df).groupBy("doc_id", "text").count().collect()}
        assert got == {(1, text): 1, (3, "own line"): 1, (7, ""): 20_000}


TOKENIZER = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [*enc.encode_ordinary(text or ""), 50256]


def test_packing(spark, odd, none, library):
    """Every sequence is whole pieces side by side, downsized to its contents; from them every document comes back."""
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        out = shared_dir(spark)
        rows = packing.op2_best_fit_packing(frame, TOKENIZER, P.PATTERN, out).collect()
        sequences = {r.bin_id: r for r in spark.read.parquet(f"{out}/sequences").collect()}
        docs = {}
        for r in rows:
            s = sequences[r.bin_id]
            ids = np.frombuffer(s.ids, "<u2")
            assert r.capacity == s.capacity == min(c for c in packing.CAPACITIES if c >= len(ids)) and zlib.crc32(s.ids) == r.sequence_crc32
            docs.setdefault(r.doc_id, []).append((r.piece, r.start, ids[r.offset : r.offset + r.n_tokens].tolist()))
        for b, s in sequences.items():
            spans = sorted((r.offset, r.n_tokens) for r in rows if r.bin_id == b)
            assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and len(s.ids) == 2 * sum(n for _, n in spans)
        want = {}
        for r in frame.collect():
            want.setdefault(r.doc_id, []).append(library(r.text))
        for d, texts in want.items():
            if len(texts) == 1:
                assert sum((x for _, _, x in sorted(docs[d])), []) == texts[0]
            assert sum(len(x) for *_, x in docs[d]) == sum(map(len, texts))
        assert set(docs) == set(want)
        tokens, space = sum(r.n_tokens for r in rows), sum(s.capacity for s in sequences.values())
    assert packing.op2_best_fit_packing(none, TOKENIZER, P.PATTERN, shared_dir(spark)).count() == 0
    assert tokens / space > 0.9


def test_best_fit_against_plain_search():
    """Piece by piece the choices of a search over all open bins: tightest room, else the size of least cost, then downsizing."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = rng.integers(1, 8193, rng.integers(1, 300))
        bins, offs, final = packing.best_fit(n)
        room, used = {}, {}
        order = np.argsort(-n, kind="stable")
        for at, i in enumerate(order):
            b, fits = int(bins[i]), [r for r in room.values() if r >= n[i]]
            if fits:
                assert room[b] == min(fits) and offs[i] == used[b]
            else:
                rest = n[order[at + 1 :]]
                size = min((packing.cost(c) / (n[i] + min(c - n[i], max(0, rest[rest <= c - n[i]].sum() - sum(room.values())))), c) for c in packing.CAPACITIES if c >= n[i])[1]
                assert b == len(room) and offs[i] == 0
                room[b], used[b] = size, 0
            room[b] -= n[i]
            used[b] += n[i]
        assert final.tolist() == [min(c for c in packing.CAPACITIES if c >= used[b]) for b in range(len(used))]
    assert len(packing.best_fit(np.zeros(0, np.int64))[2]) == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "best_fit_packing"]
    d, seen = docs, []
    for _, f in cp.STAGES[:-1]:
        d = f(spark, d, SF)
        assert d.columns == docs.columns
        seen.append(d.count())
    assert docs.count() >= seen[0] >= seen[1] >= seen[2] > 0
    assert cp.run(spark, SF).select("doc_id").distinct().count() == seen[2]


def test_pipeline_against_sql_and_counts(spark, library):
    """The first three stages follow in SQL, each on the rows the one before kept; packing places every token of what is left."""
    import corpus_pipeline as cp
    import duckdb

    from tessera.llm import quality

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for step in (
        f"SELECT d.* FROM documents d JOIN ({quality.SQL}) k USING (doc_id) WHERE kept",
        f"SELECT d.* REPLACE (k.text AS text, CASE WHEN n_removed > 0 THEN length(k.text) ELSE n_chars END AS n_chars) FROM documents d JOIN ({lines.SQL}) k USING (doc_id) WHERE n_removed = 0 OR trim(k.text) <> ''",
        f"SELECT d.* FROM documents d JOIN ({jaccard.SQL}) k USING (doc_id) WHERE k.component_id = doc_id",
    ):
        con.execute(f"CREATE TABLE next AS {step}")
        con.execute("DROP TABLE documents")
        con.execute("ALTER TABLE next RENAME TO documents")
    want = {d: len(library(t)) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    got, bins = {}, {}
    for r in cp.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.n_tokens))
    assert got == want
    for (_, capacity), parts in bins.items():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path, which):
    import corpus_pipeline as cp

    plain = [(d, " ".join(f"plain{k}" for k in range(d, d + 60)), None, None, None, None, None, None, None) for d in (900, 900, 950, 2000)]
    docs = odd.unionByName(spark.createDataFrame(plain, odd.schema)) if which == "odd" else none
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == ({900, 950, 2000} if which == "odd" else set())
    assert all(0 < r.n_tokens <= r.capacity for r in rows) and len(rows) in (0, 3)
