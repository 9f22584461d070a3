"""Entropies by array operations: as from counting in plain Python, and as the
fold over a sorted array (``signals.entropy``) that the metrics used."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpus_spark.functions import counts, signals
from corpus_spark.functions.text import chars, tokenize, word_ngrams
from corpus_spark.operators.metrics import compute_metrics

TEXTS = ["the cat sat on the mat, the cat sat", "aaaa", "", None, "a", "ab 😀😀 é x\u0000x\u0000", "one two", "a b a b a b a b " * 40]


def plain(values):
    n = len(values)
    return max(0.0, -sum(c / n * math.log2(c / n) for c in Counter(values).values())) if n else 0.0


def test_entropies(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    names = ["char_entropy", "unigram_entropy", "trigram_entropy"]
    got = {r.id: r for r in compute_metrics(df, names).select("id", *names).collect()}
    k = tokenize("text")
    old = df.select("id", "text", k.alias("k"), signals.entropy(chars(F.col("text"))).alias("char_entropy"),
                    signals.entropy(k).alias("unigram_entropy"), signals.entropy(word_ngrams(k, 3)).alias("trigram_entropy"))
    for r in old.collect():
        for name in names:
            assert abs(got[r.id][name] - r[name]) < 1e-9, (r.text, name)
        words = r.k or []
        assert abs(got[r.id].char_entropy - plain(list(r.text or ""))) < 1e-9
        assert abs(got[r.id].trigram_entropy - plain(list(zip(words, words[1:], words[2:])))) < 1e-9


def test_distinct_ngrams(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    names = ["unique_char_trigrams", "unique_trigrams", "frac_unique_trigrams"]
    got = compute_metrics(df, names).select("*").collect()
    plans = compute_metrics(df, names)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plans  # n-grams as strings, one lambda call each, before
    k, size = tokenize("text"), lambda g: F.size(F.array_distinct(g))
    want = {r.id: r for r in df.select("id", size(word_ngrams(chars(F.col("text")), 3)).alias("c"),
                                       size(word_ngrams(k, 3)).alias("t"), F.size(k).alias("n")).collect()}
    for r in got:
        w = want[r.id]
        assert (r.unique_char_trigrams, r.unique_trigrams) == (w.c, w.t)
        assert r.frac_unique_trigrams == (w.t / (w.n - 2) if (w.n or 0) >= 3 else 0.0)


def test_no_interpreted_fold(spark):
    """The metrics are one Arrow step; a fold by lambdas took seconds per million characters."""
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    for name in ("char_entropy", "unigram_entropy", "trigram_entropy"):
        plan = compute_metrics(df, [name])._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_slices_do_not_show():
    import numpy as np
    sizes = np.array([3, 0, counts.SLICE + 5, 1, 2])
    assert list(counts._slices(sizes)) == [(0, 2), (2, 3), (3, 5)]


def test_char_ngrams_without_a_lambda_for_each_character(spark):
    from corpus_spark.functions.text import char_ngrams
    texts = ["", "a", "ab", "abc", "a b  c", "    ", "\n\r\n\u2028x", "日本語 テキスト", "a\U0001F600b\U0001F601", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = df.select("id", *[char_ngrams("text", n).alias(f"g{n}") for n in (1, 2, 3, 4)])
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        t = texts[r.id] or ""
        for n in (1, 2, 3, 4):
            assert r[f"g{n}"] == [" ".join(t[i:i + n]) for i in range(len(t) - n + 1)]
