import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpus_spark.llm.common import text_buffer
from corpus_spark.llm.fingerprint import (containment, fingerprint_edits, fingerprints, from_string, likeness, merge,
                                          op8_fingerprints, sketch, text_likeness, with_next)

from .conftest import HARD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def full(texts, **kw):
    h, at = sketch(*text_buffer(pa.array(texts, pa.string())), **kw)
    return [set(h[at[i]:at[i + 1]].tolist()) for i in range(len(texts))]


def test_all_hashes_stand_for_shingles():
    texts = HARD_TEXTS + ["a b c d e f", "A B c D e F", "x a b c d e", "a b c"]
    got = full(texts, scale=1)
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_fraction_and_merge(spark):
    rnd = np.random.default_rng(1)
    words = [" ".join(f"w{x}" for x in rnd.integers(0, 500, 4000)) for _ in range(4)]
    kept, every = full(words, scale=8), full(words, scale=1)
    assert full(words) == [{h for h in e if h < 2**63} for e in every]
    for k, e in zip(kept, every):
        assert k == {h for h in e if h < 2**64 // 8} and 0.09 < len(k) / len(e) < 0.16
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(words)], "doc_id long, text string, g string")
    fps = fingerprints(df, 8).join(df.select("doc_id", "g"), "doc_id")
    union = set().union(*kept)
    (row,) = merge(fps, "g").collect()
    assert {h % 2**64 for h in row.hashes} == union
    c = fps.crossJoin(merge(fps, "g").select(F.col("hashes").alias("all"))).select(containment("hashes", "all")).collect()
    assert all(r[0] == 1.0 for r in c)


def test_fraction_is_the_same_for_short_texts(spark):
    texts = [f"short text {i}" for i in range(60)] + [f"one two three four five six seven {i} " * 2 for i in range(60)]
    got, every = full(texts), full(texts, scale=1)
    for g, e in zip(got, every):
        assert g == {h for h in e if h < 2**63}
    assert 10 < sum(map(bool, got[:60])) < 50 and sum(map(bool, got[60:])) > 55
    rows = [(i, t, i // 10) for i, t in enumerate(texts)] + [(900, texts[0], 900), (901, "short words", 900), (902, " ", 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g long")
    merged = merge(fingerprints(df).join(df.select("doc_id", "g"), "doc_id"), "g").collect()
    assert len(merged) == 13
    for r in merged:
        union = set().union(*(full([t], scale=1)[0] for _, t, g in rows if g == r.g))
        assert {h % 2**64 for h in r.hashes} == {h for h in union if h < 2**63}


def test_containment_of_short_passages_in_long_texts():
    """Passages of 5 to 20 words cut out of texts of 2000 words."""
    rnd = np.random.default_rng(3)
    long = [[f"w{x}" for x in rnd.integers(0, 5000, 2000)] for _ in range(30)]
    empty = []
    for size in (5, 8, 12, 20):
        for w in long:
            at = rnd.integers(0, 2000 - size)
            whole, part, other = (np.array(sorted(x), np.uint64) for x in full(
                [" ".join(w), " ".join(w[at:at + size]), " ".join(f"v{i}" for i in range(size))]))
            if len(part):
                assert likeness(part, whole) == 1.0 and likeness(whole, part) == 1.0
            else:
                empty.append(size)
                assert likeness(part, whole) == 0.0
            assert likeness(other, whole) == 0.0
    # one in 2**(words - 4) passages has no hash
    assert 5 < empty.count(5) < 25 and empty.count(12) <= 2 and empty.count(20) == 0
    # half of a passage from the text, half from elsewhere: the estimate's error
    errors = []
    for w in long:
        mixed = w[100:160] + [f"v{i}" for i in range(60)]
        a, b = (np.array(sorted(x), np.uint64) for x in full([" ".join(mixed), " ".join(w)]))
        errors.append(abs(likeness(a, b) - 56 / 116))
    print("mean error of half-contained passages:", np.mean(errors))
    assert np.mean(errors) < 0.08


def brute(docs):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        out[d] = (t, nxt, edited)
    return out


def check(rows, docs):
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        t, nxt, edited = want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, n = full([t, edited, nxt])
        assert set(from_string(r.fingerprint).tolist()) == a and set(from_string(r.edited_fingerprint).tolist()) == b
        for got, x, said in ((r.near_edited, b, edited), (r.near_next, n, nxt)):
            least = min(len(a), len(x))
            assert got == (len(a & x) / least if least else float(not a and not x and shingles(t) == shingles(said)))


def test_hard_texts(spark):
    docs = [((i * 37) % 101 - 30, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "no id " * 30)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, range int, hash string")
    check(fingerprint_edits(df).collect(), docs)
    check(fingerprint_edits(df.where("doc_id = -30")).collect(), docs[:1])
    assert fingerprint_edits(df.limit(0)).count() == 0
    same = spark.createDataFrame([(5, "b b"), (5, "a"), (5, "b b"), (9, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in fingerprint_edits(same).collect()) == [5, 5, 5, 9]


def test_likeness():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4, 5, 6], np.uint64)
    assert likeness(a, b) == 2 / 3 and likeness(a, a) == 1 and likeness(a[:0], b) == 0 and likeness(a[:0], a[:0]) == 0
    assert text_likeness(a[:0], a[:0], "A  b", "a B\n") == 1 and text_likeness(a[:0], a[:0], "a", "b") == 0
    assert text_likeness(a[:0], a[:0], " ", "") == 1 and text_likeness(a[:0], a, "a", "a") == 0


def test_null_and_hot_ids_are_spread(spark):
    """Most rows without an id or with one and the same: more ranges hold them, and each row has its next one."""
    rows = [(None, f"null number {i} " * 3) for i in range(400)] + [(7, f"hot number {i} " * 3) for i in range(400)]
    rows += [(i, f"row {i} " * 3) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = with_next(df).where("tail = 0").groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("i")).collect()
    assert max(r.n for r in placed) <= 200 and len(placed) >= 10
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        want.append((d, hashlib.sha256((t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in fingerprint_edits(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(op8_fingerprints(spark, d).collect(), docs)
