import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_spark.llm import toxicity
from corpus_spark.llm.common import text_buffer
from corpus_spark.llm.toxicity import (Toxicity, fit_logistic, held_buckets, labelled_texts, likelihood_ratio,
                                       log_count_ratios, op11_toxicity, score_documents, train)

from .conftest import HARD_TEXTS

LABELS = "doc_id long, quality int, toxic int"


def buckets_of(text, orders, bits):
    """Scalar version of the hashed n-grams of a text."""
    points = [ord(c.lower()) if "A" <= c <= "Z" else 32 if c in "\t\n\v\f\r" else ord(c) for c in text]
    out = set()
    for k in orders:
        for i in range(len(points) - k + 1):
            x = (sum(p * int(f) for p, f in zip(points[i:i + k], toxicity._factors)) + k) % 2**64
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
            out.add((x ^ (x >> 31)) >> (64 - bits))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \né\U0001F600", max_size=30) | st.none(), max_size=5))
def test_score_equals_plain_loops(texts):
    orders, bits = (1, 3, 4), 8
    number = np.full(1 << bits, -1, np.int32)
    number[::3] = np.arange(len(number[::3]))
    model = Toxicity(-0.4, number, np.linspace(-1, 1, len(number[::3])), orders, bits)
    got = model.score(*text_buffer(pa.array(texts, pa.string())))
    for t, s in zip(texts, got):
        total = -0.4 + sum(model.effect[number[b]] for b in buckets_of(t or "", orders, bits) if number[b] >= 0)
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    text, bucket = held_buckets(*text_buffer(pa.array(texts, pa.string())), None, orders, bits)
    assert [set(bucket[text == i].tolist()) for i in range(len(texts))] == [buckets_of(t or "", orders, bits) for t in texts]


def test_ratios_and_statistic(spark):
    one, zero = np.array([9.0, 0, 5]), np.array([1.0, 4, 5])
    assert np.allclose(log_count_ratios(one, zero, 10, 10), [math.log(10 / 2), math.log(1 / 5), 0])
    df = spark.createDataFrame([(9, 1), (0, 4), (5, 5)], "one long, zero long").coalesce(1)
    told = [r[0] for r in df.select(likelihood_ratio(df["one"], df["zero"], 10, 10)).collect()]
    want = 2 * (9 * math.log(9 / 5) + math.log(1 / 5) + math.log(1 / 5) + 9 * math.log(9 / 5))
    assert math.isclose(told[0], want) and told[2] == 0 and told[0] > told[1] > 0


def test_logistic_regression_is_at_its_minimum():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 6)) * (rnd.random((400, 6)) < 0.5)
    y = (x @ [2, -1, 0, 0, 1, 0] + rnd.normal(size=400) > 0.5).astype(float)
    row, column = np.nonzero(x)
    b, w = fit_logistic(row, column, x[row, column], y, 6, ridge=0.7)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 0.7 * w).max() < 1e-2 and abs((p - y).sum()) < 1e-2
    b, w = fit_logistic(row[:0], column[:0], x[:0, 0], np.ones(30), 6)
    assert b > 2 and not w.any()


def test_tables_and_hard_texts(spark):
    kind = [(i, f"The {i} quiet river runs past old mills and the town sleeps {i * 7}.") for i in range(150)]
    rude = [(1000 + i, f"You {i} utter blockhead, a river of nonsense {i * 3}, blockhead!") for i in range(80)]
    hard = list(enumerate(HARD_TEXTS, 5000))
    docs = spark.createDataFrame([(d, t, 0.0, "y") for d, t in kind + rude + hard + [(None, "z"), (2, "again")]],
                                 "doc_id long, text string, score double, h string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in kind] + [(d, 0, 1) for d, _ in rude]
                                   + [(7000, 1, 1), (None, 0, 0), (3, 1, None), (2, 1, 0)], LABELS)
    model = train(docs, labels)
    rows = score_documents(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    assert all(by[d] == 0 for d, _ in kind) and all(by[d] == 1 for d, _ in rude)
    assert score_documents(docs.limit(0), model).count() == 0
    nothing = train(docs.limit(0), labels.limit(0))
    assert [r.score for r in score_documents(docs.limit(3), nothing).collect()] == [0.5] * 3
    ones = train(docs, labels.where("toxic = 1"))
    assert all(r.score > 0.9 for r in score_documents(docs, ones).collect())


def test_labelled_texts_are_bounded(spark):
    """One doc_id on all rows, and rows that are all the same, stay below the bound and leave no empty sample."""
    one = next(i for i in range(10) if zlib.crc32(str(i).encode()) % 4 != 2)
    labels = spark.createDataFrame([(one, 1, 1)], LABELS)
    docs = spark.range(3000).selectExpr(f"CAST({one} AS long) AS doc_id", "concat('text ', id) AS text")
    assert labelled_texts(docs, labels, "toxic", 50).count() == 50
    same = spark.range(3000).selectExpr(f"CAST({one} AS long) AS doc_id", "'text' AS text")
    assert labelled_texts(same, labels, "toxic", 50).count() == 1


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op11_toxicity(spark, d).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out}
    caught = np.mean([rows[i].predicted for i, y in labels.items() if y == 1])
    alarms = np.mean([rows[i].predicted for i, y in labels.items() if y == 0])
    print(len(labels), caught, alarms)
    assert caught > 0.8 and alarms < 0.01
    insults = re.compile(r"\b(idiot|moron|stupid|loser|clown|worthless|pathetic|trash|disgusting|scum)\b", re.I)
    many = [i for i, t in texts.items() if len(insults.findall(t)) >= 4 and rows[i].held_out]
    assert len(many) > 50 and np.mean([rows[i].predicted for i in many]) > 0.98


def test_too_many_features(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        train(docs, spark.createDataFrame([(1, 1, 1)], LABELS), features=1 << 16)
