"""Exact distributed cut search against pandas argsort + cumsum."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpus_spark.operators import cutpoint


def brute(rows, budget):
    # rows: (m, id, w); NULL metric sorts last, ties by id
    srt = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    cum = 0
    low = set()
    for m, i, w in srt:
        cum += w
        if cum > budget:
            break
        low.add(i)
    return low


@pytest.mark.parametrize("seed", range(5))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(cutpoint, "SMALL", 7)     # force several narrowing rounds
    monkeypatch.setattr(cutpoint, "BUCKETS", 4)
    rnd = random.Random(seed)
    n = rnd.randint(50, 300)
    rows = []
    for i in range(n):
        kind = rnd.random()
        m = None if kind < 0.05 else (5.0 if kind < 0.4 else rnd.uniform(-10, 10))  # hot value
        rows.append((m, i * 3 + 1, rnd.randint(0, 20)))
    df = spark.createDataFrame(rows, "m double, id long, w long")
    total = sum(r[2] for r in rows)
    for budget in (0, total // 3, total // 2, total - 1, total):
        got = {r.id for r in cutpoint.split_by_budget(df, "m", "id", "w", budget).filter("__low").collect()}
        assert got == brute(rows, budget), budget


def test_grouped(spark, monkeypatch):
    monkeypatch.setattr(cutpoint, "SMALL", 5)
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 6)), i, 1) for i, g in enumerate(rnd.choice("abc") for _ in range(200))]
    df = spark.createDataFrame(rows, "g string, m double, id long, w long")
    budgets = {}
    for g in "abc":
        budgets[(g,)] = sum(1 for r in rows if r[0] == g) // 2
    got = {r.id for r in cutpoint.split_by_budget(df, "m", "id", "w", budgets, ["g"]).filter("__low").collect()}
    exp = set()
    for g in "abc":
        exp |= brute([(r[1], r[2], r[3]) for r in rows if r[0] == g], budgets[(g,)])
    assert got == exp


def test_auto_threshold_measures_every_text_once(spark):
    from corpus_spark.operators.threshold import auto_threshold
    measured = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(i):
        measured.add(1)
        return float(i % 97)

    df = spark.range(400).select("id", measure("id").alias("length_chars"))
    auto_threshold(df, "length_chars")
    assert measured.value == 400
