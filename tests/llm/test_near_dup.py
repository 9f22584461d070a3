import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from corpus_spark.llm import near_dup
from corpus_spark.llm.common import text_buffer
from corpus_spark.llm.near_dup import (block_links, components, drop_near_duplicates, near_duplicates,
                                       op7_near_duplicates, shingle_sets, sketch)

from .conftest import HARD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (
        frozenset([tuple(w)]) if w else frozenset())


def brute(docs, percent=80, words=4):
    """docs: (doc_id, text), distinct ids"""
    sets = {d: shingles(t, words) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {p for ds in by.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(3)
    for n in (1, 3, 40, 2000):
        a = rnd.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[: n - n // 4], rnd.integers(0, 2**63, n // 4, dtype=np.uint64)))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        t = sketch(np.concatenate((a, b)), np.array([0, n, 2 * n]), 240)
        assert (t != np.uint64(2**64 - 1)).all() and abs((t[0] == t[1]).mean() - j) < 0.12


def test_sets_equal_python():
    h, first = shingle_sets(*text_buffer(pa.array(HARD_TEXTS, pa.string())))
    assert np.diff(first).tolist() == [len(shingles(t)) for t in HARD_TEXTS]


def variants(rnd, n, words=60, edits=6, vocab=4000):
    base = [f"w{rnd.randrange(vocab)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"x{rnd.randrange(vocab)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    texts = list(HARD_TEXTS)
    for n in (2, 2, 3, 8, 150):
        texts += variants(rnd, n)
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that many documents share
    texts += [shared + " " + " ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(10, 40))) for _ in range(80)]
    texts += ["same same same same same"] * 30
    ids = rnd.sample(range(-500, 5000), len(texts))
    docs = list(zip(ids, texts))
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, node int, key string")
    want = brute(docs)
    assert sorted(map(tuple, near_duplicates(df).collect())) == want
    for name, value in (("BLOCK_NODES", 7), ("HOT", 20)):  # many blocks, and more stars
        monkeypatch.setattr(near_dup, name, value)
    assert sorted(map(tuple, near_duplicates(df).collect())) == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, ""), (5, None), (6, "q")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, 2, None, True), (4, 2, None, False), (4, 2, None, False), (5, 0, 5, True), (5, 0, 5, True), (6, 1, 6, True)]))


def test_different_sets_under_one_id(spark):
    rnd = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (3, a + " end"), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, content=True)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(3, 58, 3, True), (5, 57, 3, False), (5, 57, 5, True), (5, 57, 5, True)]
    assert sorted(map(tuple, drop_near_duplicates(df, got).collect())) == [(3, a + " end"), (5, b)]
    rows = [(None, a), (None, b), (None, c), (None, d), (7, b + " x"), (8, c + " x"), (9, d + " x"), (10, "lone words of its own")]
    rnd.shuffle(rows)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 57, None, True), (7, 58, None, False), (8, 58, None, False), (9, 58, None, False), (10, 2, 10, True)}
    # a chain of near copies whose least doc_id is at one end
    texts = variants(rnd, 30, edits=2)
    docs = [(40 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(docs)


def test_components_and_blocks(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        x, y = want.get(a, {a}), want.get(b, {b})
        z = x | y
        for k in z:
            want[k] = z
    assert got == {k: min(v) for k, v in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    found = block_links(np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([True, False, False]), False,
                        [s.tobytes() for s in sets], 80)
    assert found == [(1, 2)]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_near_duplicates(spark, d).collect())) == brute(docs)


def test_oracle_sql_equals_the_query(spark):
    import duckdb

    from corpus_spark.llm.near_dup import OP7_SQL
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(OP7_SQL)
    got = op7_near_duplicates(spark, d).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
