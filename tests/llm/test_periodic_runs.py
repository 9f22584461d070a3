import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_spark.llm.common import hash_spans, text_buffer, word_spans
from corpus_spark.llm.periodic_runs import collapse_runs, common_prefixes, find_runs, op12_periodic_runs

from .conftest import HARD_TEXTS


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def brute(w, min_length=6, min_exponent=4):
    """All stretches that keep a period and cannot be extended, period by period."""
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        s = 0
        while s + q < len(w):
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e > s + q and e - s >= max(min_length, min_exponent * q) and smallest_period(w[s:e]) == q:
                out.append((s, e - s, q))
            s = max(s + 1, e - q + 1) if e > s + q else s + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_of(texts, *rule):
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(buf, offsets)
    found = find_runs(hash_spans(buf, starts, ends), first, *rule)
    return [found.get(i, []) for i in range(len(texts))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4),
       st.sampled_from([(6, 4), (2, 2), (1, 3), (9, 2)]))
def test_runs_of_few_words(docs, rule):
    assert runs_of([" ".join(d) for d in docs], *rule) == [brute(d, *rule) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    w = [x for part, n in pieces for x in part * n]
    assert runs_of([" ".join(w)]) == [brute(w)]


def test_runs_of_known_sequences():
    thue, fib, before = ["a"], ["a", "b"], ["a"]
    for _ in range(9):
        thue = thue + [{"a": "b", "b": "a"}[x] for x in thue]
        fib, before = fib + before, fib
    assert runs_of([" ".join(thue), " ".join(fib)], 2, 2) == [brute(thue, 2, 2), brute(fib, 2, 2)]
    assert runs_of([" ".join(thue), " ".join(fib)]) == [[], []]
    many = " ".join(["lead"] + ["one", "two", "three"] * 40_000 + ["tail"])
    assert runs_of([many, "x " * 100_000]) == [[(1, 120_000, 3)], [(0, 100_000, 1)]]
    # a passage that comes back thousands of times with another word before each
    assert runs_of([" ".join(f"w{i} the same six words stand here" for i in range(5000))]) == [[]]


def test_common_prefixes():
    w = [1, 2, 1, 2, 1, 3]
    order = sorted(range(6), key=lambda i: w[i:])
    assert common_prefixes(w, order, 1) == [0] + [
        next(n for n in range(7) if n == 6 - max(a, b) or w[a + n] != w[b + n]) for a, b in zip(order, order[1:])]


def test_tables_and_hard_texts(spark):
    texts = HARD_TEXTS + ["a b a b a b a b c", "no no no no no no", "no no no no no"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "x y " * 4), (3, "x y " * 4)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, runs string, start int")
    out = collapse_runs(df)
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 12000, 3)] if len(w) == 12000 else brute(w)
        want.append((d, runs, collapsed(w, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert collapse_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collapse_runs(df, min_exponent=1)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op12_periodic_runs(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    some = 0
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 1500 else runs_of([" ".join(w)])[0]
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        r = rows[doc_id]
        some += len(runs)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 5
