"""Sizes from the reference's own test expectations (see FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import clean, dedup, partition as part, threshold as thr
from corpus_spark.operators.stats import corpus_stats


def test_exact_dedup(mono):
    assert dedup.dedup_exact(mono).count() == 4


@pytest.mark.parametrize("metric,t", [("length_chars", 40), ("length_words", 10)])
def test_threshold(mono, metric, t):
    out = thr.apply_threshold(mono, {metric: t})
    assert out.count() == 5
    assert set(out.columns) == {"id", "text"}


@pytest.mark.parametrize("method,metric,low,high", [
    ("balanced_chars", "length_chars", 4, 4),
    ("mean_cutoff", "length_words", 3, 5),
    ("median_cutoff", "length_words", 3, 5),
    ("balanced_docs", "length_words", 4, 4),
])
def test_partition_sizes(mono, method, metric, low, high):
    assert part.partition(mono, metric, method, quality=False).count() == low
    assert part.partition(mono, metric, method, quality=True).count() == high


def test_halves_disjoint_and_complete(mono):
    lo = part.partition(mono, "length_chars", "balanced_chars", quality=False).select("id")
    hi = part.partition(mono, "length_chars", "balanced_chars", quality=True).select("id")
    assert lo.intersect(hi).count() == 0
    assert lo.union(hi).distinct().count() == mono.count()


def test_script_filter_latin(multi):
    out = clean.pre_filter(multi, scripts=["Latn"])
    rows = out.collect()
    assert len(rows) == 3
    src = {r.id: r.text for r in multi.collect()}
    assert all(r.text == src[r.id] for r in rows)


def test_corpus_stats(multi):
    st = {r.language: (r.docs, r.chars) for r in corpus_stats(multi).collect()}
    assert st["eng"][0] == 3 and st["rus"][0] == 1 and st["zho"] == (1, 9)


def test_pre_filter_needs_a_filter(mono):
    with pytest.raises(ValueError):
        clean.pre_filter(mono)


def test_hostile_rows(spark):
    rows = ["", "   ", " 　", "a\r\nb", "x\u2028y", "\U0001F600 emoji", "éte",
            "Hello мир! 123", "12345", "one", "a b", "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    out = {r.id: r.text for r in clean.pre_filter(df, scripts=["Latn"]).collect()}
    assert 0 not in out and 1 not in out and 2 not in out
    assert out[3] == "a\nb" and out[4] == "x\ny"
    assert out[7] == "Hello "
    # "a b" and "ab" have the same exact hash (tokens joined without separator)
    h = {r.id: r.h for r in dedup.dedup_exact(df).select("id", F.lit(1).alias("h")).collect()}
    assert 3 in h and 10 not in h and 11 not in h   # "a\r\nb", "a b", "ab" share a hash

