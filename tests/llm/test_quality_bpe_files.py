import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, quality, tokenfile
from tessera.llm.store import shared_dir
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return tuple((x is not None, x) for x in r)


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    seen, twice = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                twice.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_quality_counts(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.op4_quality_rules(docs).collect()
    want = []
    for r in docs.collect():
        s = stats(r.text)
        want.append((r.doc_id, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_thresholds(spark):
    """A language's clean documents stay, one full of symbols goes, although another language is full of them."""
    clean = "plain words make up this text and nothing else is found in here because number {} is an ordinary one of its kind"
    marks = "".join(f" ##{i}" for i in range(20))
    rows = [(i, clean.format(i), "en", "a", 1) for i in range(300)]
    rows += [(1000 + i, clean.format(i) + marks, "xx", "b", 1) for i in range(300)]
    rows += [(5000, clean.format("x") + marks, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.op4_quality_rules(docs).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {5000}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept
    assert quality.keep_good(docs).columns == docs.columns


def _counts(spark, groups):
    """A stats frame of groups {(lang, source): rows of the six counts}."""
    rows = [(i, g[0], g[1], *r) for i, (g, r) in enumerate((g, r) for g, rs in groups.items() for r in rs)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


@pytest.mark.parametrize("signal,shift", [("word_len", lambda k: (400, 400 * 9 + k % 40, 0, 40, 0, 0)), ("symbols", lambda k: (400, 2000, 300 + k % 40, 40, 0, 0)), ("dup_lines", lambda k: (400, 2000, 0, 40, 18 + k % 3, 0)), ("repeats", lambda k: (400, 2000, 0, 40, 0, 90 + k % 20))])
def test_every_fence_moves_with_its_group(spark, signal, shift):
    """A group that is like that throughout keeps its documents; the same document elsewhere goes or has a lower fence."""
    plain = lambda k: (400, 2000 + k % 40, 0, 40, 0, 0)
    stats = _counts(spark, {("en", "plain"): [plain(k) for k in range(400)], ("en", "other"): [shift(k) for k in range(400)], ("fr", "plain"): [plain(k) for k in range(400)]})
    fence = quality.fences(quality.sketches(stats))
    high = {(r.lang, r.source): r[f"high_{signal}"] for r in fence.collect()}
    assert high["en", "other"] > 1.3 * high["en", "plain"] + 20 and high["en", "plain"] >= high["fr", "plain"]
    kept = {r.doc_id: r.kept for r in quality.judge(stats, fence).collect()}
    assert all(kept.values())


def test_small_groups_lean_on_their_language(spark):
    """The more documents a group has, the nearer its fence is to its own data, without a step."""
    plain, marked = (400, 2000, 0, 40, 0, 0), (400, 2000, 400, 40, 0, 0)
    high = []
    for n in (1, 10, 50, 199, 200, 201, 1000):
        stats = _counts(spark, {("en", "big"): [plain] * 20_000, ("en", "small"): [marked] * n})
        high.append(next(r.high_symbols for r in quality.fences(quality.sketches(stats)).collect() if r.source == "small"))
    assert high == sorted(high) and high[0] < 200 and high[-1] > 1800 and high[5] - high[3] < 20


def test_quality_sketch_merges(spark):
    v = [*range(0, 3000, 7), 64, 65, 127, 128, 1 << 40]
    r = spark.createDataFrame([(x,) for x in v], "v long").select("v", quality.bucket(F.col("v")).alias("b")).select("*", quality.bucket_low(F.col("b")).alias("lo")).collect()
    for x in r:
        assert x.lo <= x.v < x.lo * (1 + 1 / 32) + 1
    b = [x.b for x in sorted(r)]
    assert b == sorted(b)


def test_keep_good_on_odd_rows(spark, odd):
    odd = odd.unionByName(odd.sparkSession.createDataFrame([(d, " ".join(f"plain{k}" for k in range(d, d + 60)), None, "s", 1, None, None, None, None) for d in (900, 900, 950)], odd.schema))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    judged = {(r.doc_id, r.n_words): r.kept for r in quality.op4_quality_rules(odd).collect()}
    rows = [(r.doc_id, len(WORD.findall(r.text or ""))) for r in kept.collect()]
    assert len(rows) >= 3 and all(judged[x] for x in rows)
    assert len(rows) == sum(judged[r.doc_id, len(WORD.findall(r.text or ""))] for r in odd.collect())


def test_empty_tables(spark, none):
    assert quality.op4_quality_rules(none).count() == 0
    assert quality.keep_good(none).count() == 0
    assert bpe.op7_byte_bpe(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert tokenfile.op10_token_files(none, P.path("word_bpe_49k.json"), shared_dir(spark)).count() == 0


@pytest.mark.parametrize("which", ["odd", "real"])
def test_byte_bpe(spark, odd, which):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((tuple(x) for x in bpe.op7_byte_bpe(docs, path, P.PATTERN).collect()), key=key) == sorted(want, key=key)


def test_byte_bpe_cache_generations(monkeypatch):
    """However few pre-tokens are kept, the ids are the same."""
    path = P.path("byte_bpe_50k.tiktoken")
    text = " ".join(f"word{i % 23} thing{i % 7}" for i in range(400))
    want = bpe.BytePieceTokenizer(path, P.PATTERN).encode(text)
    monkeypatch.setattr(bpe, "CACHE", 5)
    few = bpe.BytePieceTokenizer(path, P.PATTERN)
    assert few.encode(text) == want and len(few) <= 5 and len(few.old) <= 5


def test_byte_bpe_frame(spark, odd):
    path = P.path("byte_bpe_50k.tiktoken")
    t = bpe.BytePieceTokenizer(path, P.PATTERN)
    for r in bpe.encode_frame(odd, path, P.PATTERN, keep=("doc_id", "lang")).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert t.decode(np.frombuffer(r.ids, "<u4").tolist()).decode() == (r.text or "")


@pytest.mark.parametrize("which", ["odd", "real"])
def test_token_files(spark, odd, which):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    got = sorted((tuple(r) for r in tokenfile.op10_token_files(docs, P.path("word_bpe_49k.json"), shared_dir(spark)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in rows]
    start, crc = 0, lambda s: (len(s), zlib.crc32(np.array(s, "<u4").tobytes()))
    ids = {x: t.encode(x, add_special_tokens=False).ids + [1] for _, x in rows}
    by_id = {}
    for i, x in rows:
        by_id.setdefault(i, []).append(crc(ids[x]))
    for r in got:
        assert r[1] == start and (r[2], r[3]) in by_id[r[0]]
        start += r[2]
    assert start == sum(len(ids[x]) for _, x in rows)


def test_token_files_compose_before_folding():
    """Letters with a mark whose composed form exists only in lower case."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), tokenfile.WordCacheEncoder(path, 1)
    marked = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = ["a J\u030c x b", *(f"Plain {m}ELLO Two{m}. {m}, {m.lower()} END" for m in marked), " ".join(marked)]
    for x, ids in zip(texts, enc.texts([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, f"<u{enc.width}").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_token_ids_of_random_texts():
    """Marks, joiners, odd spaces, special tokens, contractions and numbers in random order: the library's ids of the whole text."""
    import random

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), tokenfile.WordCacheEncoder(path, 1)
    rng = random.Random(11)
    bits = [*"aTJHWYIZéİßΣςǅ１2.,'!-_<|>#", "\u0300", "\u0308", "\u030a", "\u030c", "\u0331", "\u0327", "\u1ab0", "\u200b", "\u200d", "\u00ad", "\ufeff", "\u2028", "\u00a0", "\u3000", "\x85", "\x1c", "\x00", " ", "\t", "\n", "\r\n", "\x0b",
            "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "n't", "한", "漢", "ﬁ", "🙂", "\U0001f468\u200d\U0001f469", "word", "WORD.", "Two,", "e\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 24))) for _ in range(20_000)]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for x, ids in zip(part, enc.texts([x.encode() for x in part]), strict=True):
            assert np.frombuffer(ids, f"<u{enc.width}").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)


def test_token_ids_look_up_distinct_chunks(monkeypatch):
    """A batch asks the cache once for each distinct chunk, however often it occurs; slices of Arrow columns do, and any generation of the cache."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def __getitem__(self, k):
            Counted.asked += 1
            return super().__getitem__(k)

    path = P.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), tokenfile.WordCacheEncoder(path, 1)
    enc.now = Counted()
    texts = ["left out", "", " \t\n", " Word. word, WORD  Ünder <|endoftext|>X\x0b" * 500, "a", "last word", "left out"]
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    read = lambda got: [np.frombuffer(x, f"<u{enc.width}").tolist() for x in got]
    assert read(enc.texts([x.encode() for x in texts])) == want and Counted.asked < 50
    assert read(enc.texts(pa.array([x.encode() for x in texts]).slice(1, 5))) == want[1:6]
    monkeypatch.setattr(tokenfile, "CACHE", 2)
    for _ in range(4):
        assert [read(enc.texts([x.encode()])) for x in texts] == [[w] for w in want]
    assert enc.texts([]) == []


def test_token_ids_of_letters_and_marks():
    """Chunks of letters and marks go to the model straight, with the library's ids; those with anything else do not."""
    import random

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), tokenfile.WordCacheEncoder(path, 1)
    assert enc.letters
    rng, bits = random.Random(12), [*tokenfile.LETTERS, *".,!?*#-_`()[]{}\\/:;=+'<|>012ªµºÿĀſß÷×ŉ", "\u0300", "\u0327"]
    chunks = ["".join(rng.choice(bits) if rng.random() < 0.5 else rng.choice("etaoinEé.!") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    for x, ids in zip(chunks, enc.texts([x.encode() for x in chunks]), strict=True):
        assert np.frombuffer(ids, f"<u{enc.width}").tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)
    asked = []
    batch = enc.t.encode_batch
    enc.t = type("Seen", (), {"model": enc.t.model, "encode": enc.t.encode, "encode_batch": lambda self, x, **k: asked.extend(x) or batch(x, **k)})()
    enc.texts(["Straßenübergänge, déjàvus!! newwordhere. it's a1 <|endoftext|> J\u030c".encode()])
    assert {"Straßenübergänge,", "déjàvus!!", "newwordhere."}.isdisjoint(asked)


def test_token_file_random_access(tmp_path):
    from pyarrow import fs

    path, lists = str(tmp_path / "x.tok"), [list(range(i % 7 * 9000)) for i in range(40)]
    with open(path, "wb") as f:
        w = tokenfile.FileWriter(f, 4)
        for i, x in enumerate(lists):
            w.add(i, np.array(x, "<u4").tobytes())
        w.close()
    r = tokenfile.FileReader(fs.LocalFileSystem().open_input_file(path))
    read, frame = [], r.frame
    r.frame = lambda k: read.append(k) or frame(k)
    assert [(d, x.tolist()) for d, _, x in r.documents({5, 31})] == [(5, lists[5]), (31, lists[31])]
    assert len(set(read)) <= 2 < len(r.seek)
    import zstandard

    raw = b"".join(zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read() for _ in range(1))
    assert raw == b"".join(np.array(x, "<u4").tobytes() for x in lists)  # any zstandard reader skips the index and seek frames
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        list(tokenfile.FileReader(fs.LocalFileSystem().open_input_file(path)).documents())
