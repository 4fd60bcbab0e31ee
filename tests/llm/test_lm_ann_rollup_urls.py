import base64
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import ann, lm, rollup, urls
from tessera.llm.store import Workspace, shared_dir
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), None]


@pytest.mark.parametrize("which,hot", [("odd", 500_000), ("real", 500_000), ("real", 50)])
def test_lm_base(spark, odd, which, hot, monkeypatch):
    monkeypatch.setattr(lm.train, "__defaults__", (*lm.train.__defaults__[:-1], hot))
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(t for d, x in rows if not out(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((d is not None, d or 0), out(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 4)) for d, x in rows)
    res = lm.op1_lm_scores(docs).collect()
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in res)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=2e-4)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in res)
    if which == "real":  # on texts it has not seen the model is better than the base
        held = [r for r in res if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_counts_by_probing(spark):
    """Counts read back from the filter: right up to a level for what is in it, and absent for nearly all that is not."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(300) if i % (j + 1) == 0)) for i in range(400)], "doc_id long, t string")
    docs = docs.withColumn("t", docs.t.cast("binary"))
    ws = Workspace(spark)
    model, saved = lm.train(ws, docs, "t", 4)
    from tessera.llm import words as W
    import pyarrow as pa

    c = Counter(w for r in docs.collect() for w in r.t.decode().split())
    b = next(W.blocks(pa.array([" ".join(sorted(c))]), True))
    level = model.levels(b.word, 1)
    truth = lm.level_of(np.array([c[w] for w in sorted(c)]))
    assert (level >= truth).all() and (level == truth).mean() > 0.9
    unseen = next(W.blocks(pa.array([" ".join(f"z{i}" for i in range(5000))]), True))
    assert (model.levels(unseen.word, 1) > 0).mean() < 0.06
    assert len(model.filter) <= lm.MAX_BYTES and model.tokens == sum(c.values()) + 400 and model.vocabulary == len(c) + 1
    small, _ = lm.train(Workspace(spark), docs, "t", 4, max_bytes=1 << 8)
    assert len(small.filter) == 0 and not small.whole and small.filter_bytes == model.filter_bytes == len(model.filter)
    lv = lm.level_of(np.arange(1, 5000))
    est = lm.count_of(lv)
    assert (np.abs(est - np.arange(1, 5000)) <= 0.13 * np.arange(1, 5000) + 1e-9).all()


def test_lm_is_a_distribution(spark):
    """Over all words, the probabilities after a history sum to no more than 1 (and little less)."""
    docs = spark.createDataFrame([(i, "a b c d a b a c e f".split()[i % 10] + " a b c d a b") for i in range(50)], "doc_id long, t string")
    model, _ = lm.train(Workspace(spark), docs.withColumn("t", docs.t.cast("binary")), "t", 4)
    from tessera.llm import words as W
    import pyarrow as pa

    total = 0.0
    for w in "abcdef":
        b = next(W.blocks(pa.array([f"a {w}"]), True))
        total += 10 ** model.log10_probability(*lm.token_stream(b))[1]
    b = next(W.blocks(pa.array(["a"]), True))
    total += 10 ** model.log10_probability(*lm.token_stream(b))[1]
    assert 0.8 < total < 1.1


def test_lm_filter_beyond_the_broadcast(spark, odd, monkeypatch):
    """A filter above the limit is probed where it was built: the same scores, and the bits an entry stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = lambda d: sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.op1_lm_scores(d).collect())
    want = [score(d) for d in (docs, odd)]
    d = docs.select(docs.text.cast("binary").alias("t"))
    whole, _ = lm.train(Workspace(spark), d, "t", 4)
    assert whole.whole and np.unpackbits(whole.filter).mean() < 0.5
    for hot in (lm.HOT_WORDS, 50):
        defaults = (*lm.train.__defaults__[:-2], 0, hot)
        monkeypatch.setattr(lm.train, "__defaults__", defaults)
        assert [score(d) for d in (docs, odd)] == want


def test_lm_score_from_exact_counts(spark):
    """The score is the interpolation of quantised exact counts but for the filter's false positives, which only raise counts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    seqs = {d: tokens(x) for d, x in rows}
    uni, bi = Counter(), Counter()
    for d, s in seqs.items():
        if not out(d):
            uni.update(s)
            bi.update(zip(["<", *s], s))
    n, v, texts = sum(uni.values()), len(uni), sum(not out(d) for d in seqs)
    q = lambda c: float(lm.count_of(lm.level_of(np.array([c])))[0]) if c else 0.0
    got = {r.doc_id: r for r in lm.op1_lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    near = 0
    for d, s in seqs.items():
        total = 0.0
        for h, w in zip(["<", *s], s):
            p, c = (q(uni[w]) + 1) / (n + v + 1), texts if h == "<" else q(uni[h])
            total += math.log10(lm.LAMBDA * min(q(bi[h, w]) / c, 1) + (1 - lm.LAMBDA) * p if c else p)
        assert got[d].score >= total - 0.02 * len(s)  # a history whose count reads too high
        near += abs(got[d].score - total) <= 0.08 * len(s)
    assert near >= 0.95 * len(seqs)


def test_lm_repeats_are_told_apart(spark):
    """A held-out text whose words followed each other once in training scores above one of the same words in another order."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    free = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    rows = list(zip(free, texts)) + [(i, texts[k]) for k, i in enumerate(held[:20])] + [(i, " ".join(rng.permutation(texts[k].split()))) for k, i in enumerate(held[20:])]
    got = {r.doc_id: r.score for r in lm.op1_lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in held[:20]) > max(got[i] for i in held[20:])


def test_lm_empty(spark, none):
    assert lm.op1_lm_scores(none).count() == 0


def brute(rows, top, every):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        best = sorted({(-float(v @ w), i) for i, w in ok if i != q and len(w) == len(v)})[:top]
        out[q] = [(i, -s) for s, i in best]
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_nearest_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()], 20, 20)
    got = found(ann.op8_nearest(e, shard_size=1500))
    assert recall(got, want) >= 0.9 and all(len(got[q]) == 20 for q in want)
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, w in got.items() for i, s in w if (q, i) in exact)


def test_nearest_odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rows[0][1], 1) for i in range(300)] + [rows[3], rows[3]]
    rows += [(500, None, 1), (520, [0.0] * 8, 1), (540, [float("nan")] + [1.0] * 7, 1), (560, [float("inf")] + [1.0] * 7, 1), (580, [], 1), (600, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (620, [1.0, 2.0], 1), (640, [2.0, 1.0], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(6)
    want = brute([(r.vec_id, r.embedding) for r in e.collect()], 20, 20)
    got = found(ann.op8_nearest(e))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q in (0, 100, 120):  # copies of one vector: all alike, the smallest ids
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert [i for i, _ in got[620]] == [640]
    assert ann.op8_nearest(e.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["gaussian", "log-normal", "one long", "tiny", "huge"])
def test_nearest_whatever_the_lengths(spark, kind):
    """Vectors of differing lengths and of extreme magnitudes: recall of 0.9 and all 20 answers."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 32))
    if kind == "log-normal":
        x *= rng.lognormal(size=(900, 1))
    if kind == "one long":
        x[5] *= 1e4
    x *= {"tiny": 1e-50, "huge": 1e40}.get(kind, 1.0)
    rows = list(enumerate(x.tolist()))
    want = brute(rows, 20, 20)
    got = found(ann.op8_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_size=500))
    assert recall(got, want) >= 0.9 and all(len(got[q]) == 20 for q in want)


def test_bands_hold_like_lengths():
    rng = np.random.default_rng(3)
    for length in (np.sort(rng.lognormal(size=700))[::-1], np.ones(300), np.array([5.0]), np.r_[1e30, np.ones(63)]):
        at = ann.bands(length)
        assert at[0] == 0 and at[-1] == len(length) and (np.diff(at) > 0).all()
        for lo, hi in zip(at[:-1], at[1:]):
            assert hi - lo < 2 * ann.LEAST or length[lo] <= length[hi - 1 - ann.LEAST] * ann.BAND * (1 + 1e-9)


def test_graph_edges_are_diverse():
    rng = np.random.default_rng(1)
    x, _ = ann.directions(rng.normal(size=(300, 6)))
    x[200:] = x[200]  # copies that pruning may leave without a way in
    g, starts = ann.build_graph(x)
    assert g.shape == (300, ann.DEGREE) and (g < 300).all()
    seen, todo = set(starts.tolist()), starts.tolist()
    while todo:
        for j in g[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) == 300
    y = x[:200]
    d = lambda i, j: float(((y[i] - y[j]) ** 2).sum())
    p = np.array([0, 1])
    out = ann.robust_prune(p, np.tile(np.arange(200), (2, 1)), y, 16, 1.2)
    for i in p:
        kept = [j for j in out[i] if j >= 0]
        assert kept[0] == min((j for j in range(200) if j != i), key=lambda j: d(i, j))
        assert all(1.2**2 * d(a, b) > d(i, b) for k, b in enumerate(kept) for a in kept[:k])


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).fetchall()


VERSIONS = {"one": P.path("byte_bpe_50k.tiktoken"), "multi": P.path("byte_bpe_multi_50k.tiktoken")}


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rollup_against_plain_counts(spark):
    """All batches at once: what is left of the documents, counted by the library."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels"))
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    poor = {r.doc_id for r in labels if r.quality == 0} - toxic
    want = Counter()
    for name, path in VERSIONS.items():
        enc = library(path)
        for r in docs:
            if r.doc_id not in toxic:
                text = "\n".join(dict.fromkeys(r.text.split("\n"))) if r.doc_id in poor else r.text
                want[r.source, r.lang, name, "docs"] += 1
                want[r.source, r.lang, name, "tokens"] += len(enc.encode_ordinary(text))
    got = rollup.op3_token_counts(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), shared_dir(spark), VERSIONS, P.PATTERN).collect()
    assert {(r.source, r.lang, r.version, k): v for r in got for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens))} == dict(want)


def test_rollup_batches_once(spark, odd, none):
    led = rollup.TokenLedger(spark, shared_dir(spark))
    assert led.totals().count() == 0
    n = rollup.counted(odd, VERSIONS, P.PATTERN)
    assert led.apply("b1", rollup.signed(n, 1)) and not led.apply("b1", rollup.signed(n, 1))
    first = sorted(map(repr, led.totals().collect()))
    led.compact()
    assert sorted(map(repr, led.totals().collect())) == first and led.batches() == ["b1"]
    assert not led.apply("b1", rollup.signed(n, 1))
    again = rollup.TokenLedger(spark, led.root)  # a restarted job
    assert not again.apply("b1", rollup.signed(n, 1)) and again.apply("b2", rollup.signed(n, -1))
    assert again.totals().count() == 0
    led.compact()
    assert led.batches() == ["b1", "b2"] and led.totals().count() == 0
    assert led.apply("b3", rollup.signed(rollup.counted(none, VERSIONS, P.PATTERN), 1))
    op = lambda docs, labels: rollup.op3_token_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), shared_dir(spark), VERSIONS, P.PATTERN)
    assert op(none, [(1, 1, 1)]).count() == 0
    assert sum(r.n_docs for r in op(odd, [(5, 0, 0), (5, 0, 0), (7, 1, 1), (999, 0, 1)]).collect()) == 2 * (odd.count() - 1)
    assert sum(r.n_docs for r in op(odd, []).collect()) == 2 * odd.count()


def test_rollup_commit_during_compaction(spark, odd, monkeypatch):
    """A batch that is committed while older ones are folded is counted once."""
    led, n = rollup.TokenLedger(spark, shared_dir(spark)), rollup.counted(odd, VERSIONS, P.PATTERN)
    led.apply("b1", rollup.signed(n, 1))
    commit = led._commit

    def between(df, to, note=""):
        if to.startswith("snapshots"):
            commit(rollup.signed(n, 1).groupBy(*rollup.KEYS).agg(*(rollup.F.sum(c).cast("long").alias(a) for c, a in (("sign", "n_docs"), ("n_tokens", "n_tokens")))), "batches/b2")
        return commit(df, to, note)

    monkeypatch.setattr(led, "_commit", between)
    led.compact()
    assert led.batches() == ["b1", "b2"] and sum(r.n_docs for r in led.totals().collect()) == 4 * odd.count()


def py_rule(host, path):
    best = None
    for v, r in urls.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


PAGES = [
    ("http://Ab.Example.ORG/es/1?x#y", None), ("https://example.org/en/12", ""), ("https://a.org", "<p>"), ("nothing", None), (None, None), ("http://x.com/fr/1", None), ("http://x.com/de/1", None),
    ("http://one.net/a", '<link rel="canonical" href="http://x.com/de/9">'),
    ("http://two.net/b#frag", "<META content='0; URL=http://one.net/a' http-equiv='Refresh'>"),
    ("http://three.net/", '<!-- <link rel="canonical" href="http://x.com/de/9"> -->'),
    ("http://four.net/q?a=1", "<link href=//two.net/b rel=canonical>"),
    ("http://five.net/dir/p", '<link rel="canonical" href="../x"><link rel="canonical" href="/home">'),
    ("http://five.net/home", '<link rel="canonical" href="http://fine.org/">'),
    ("http://six.net/", '<link rel="canonical" href="http://five.net/home"><link rel="canonical" href="http://x.com/de/9">'),
    ("http://seven.net", '<link rel="canonical" href="http://x.com/de/3">'), ("http://seven.net/", ""), ("http://example.org/es/own", '<link rel="canonical" href="http://fine.org/">'),
]


def test_url_filters(spark):
    rows = [(i, u, h, "clash") for i, (u, h) in enumerate(PAGES)] + [(3, PAGES[3][0], None, "clash")]
    got = urls.op6_url_filters(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"))
    by = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows) and urls.op6_url_filters(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    for i, (u, _) in enumerate(PAGES):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.match("[^/?#]*", rest).group().lower() if rest else ""
        path = re.match("[^?#]*", rest[len(host) :]).group() if rest else ""
        rule = py_rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule[1])
        if rule:
            assert by[i].verdict == rule[0]
    # one.net, two.net and four.net are aliases of five.net's allowed group through x.com/de/9 and six.net
    assert {i: by[i].verdict for i in (7, 8, 9, 10, 11, 12, 13, 14, 15)} == {7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "block", 15: "block"}
    blocked = urls.op6_url_filters(spark.createDataFrame([r for r in rows if r[0] not in (12, 13, 16)], "page_id long, url string, html string, rule string"))
    assert {r.page_id for r in blocked.collect() if r.rule is None and r.verdict == "block"} == {7, 8, 10, 14, 15}
    assert by[16].verdict == "block"  # a page's own rule comes first


def test_url_filters_against_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted(map(tuple, urls.op6_url_filters(pages).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(duck(urls.SQL), key=str)


def test_url_filters_with_long_pages_and_a_hub(spark):
    """A homepage with thousands of aliases, one of them in a very long page, and a very long address."""
    far = "http://x.com/de/" + "a" * 60_000
    rows = [(i, f"http://h{i}.net/", f'<link rel="canonical" href="http://home.net/">') for i in range(3000)]
    rows += [(5000, "http://long.net/", "<p>" + "x " * 200_000 + f'<link rel="canonical" href="{far}">'), (5001, "http://long.net/2", '<link rel="canonical" href="http://long.net/">'), (5002, far, None)]
    rows += [(6000, "http://home.net/", f'<link rel="canonical" href="{far}">')]
    got = {r.page_id: r for r in urls.op6_url_filters(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and {r.verdict for r in got.values()} == {"block"} and got[5002].rule == "com/de/" and got[7].rule is None
