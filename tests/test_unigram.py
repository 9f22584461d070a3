import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from corpus_spark.operators import unigram
from corpus_spark.operators.encoders import Lattice, _words
from corpus_spark.operators.unigram import expected_counts, frequent_substrings, losses, train_unigram


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, count long")


def some_words(seed=1, n=300):
    rnd = random.Random(seed)
    parts = ["un", "like", "ly", "help", "ful", "ness", "é\U0001F600", "re", "do", "ing", "a"]
    return Counter("".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(n))


def segmentations(word, scores):
    if not word:
        return [(0.0, [])]
    return [(scores[word[:i]] + s, [word[:i]] + rest) for i in range(1, len(word) + 1) if word[:i] in scores
            for s, rest in segmentations(word[i:], scores)]


def test_frequent_substrings_equal_counting(spark):
    words = some_words()
    seen = Counter()
    for w, c in words.items():
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + 6) + 1):
                seen[w[i:j]] += c
    for least in (2, 5, 40):
        got = {r["piece"]: r["count"] for r in frequent_substrings(table(spark, words), least, 6).collect()}
        assert got == {p: n for p, n in seen.items() if n >= least}
    assert frequent_substrings(table(spark, {"a": 9}), 2, 6).count() == 0


def test_expected_counts_equal_all_segmentations():
    words = {"ababa": 3, "bé": 2, "b": 5, "aab": 1}
    scores = {"a": -1.0, "b": -2.0, "é": -3.0, "ab": -1.5, "aba": -2.5, "ba": -1.7, "bé": -4.0}
    want, likelihood = Counter(), 0.0
    for w, c in words.items():
        every = segmentations(w, scores)
        z = math.log(sum(math.exp(s) for s, _ in every))
        likelihood += c * z
        for s, parts in every:
            for p in parts:
                want[p] += c * math.exp(s - z)
    lattice = Lattice(scores)
    got, ll = expected_counts(lattice, *_words(pa.array(list(words))), np.array(list(words.values()), float))
    assert math.isclose(ll, likelihood) and np.allclose(got, [want[p] for p in lattice.pieces])


def test_losses_equal_the_best_other_segmentation(spark):
    scores = {"a": -1.0, "b": -2.0, "é": -3.0, "ab": -1.5, "aba": -2.5, "ba": -1.7, "bé": -4.0}
    counts = np.arange(1.0, 8.0)
    got = losses(spark, Lattice(scores), counts)
    for p, c, g in zip(scores, counts, got):
        others = scores if len(p) == 1 else {q: s for q, s in scores.items() if q != p}
        assert math.isclose(g, c * (scores[p] - max(s for s, _ in segmentations(p, others))), abs_tol=1e-9)


def test_likelihood_never_falls_and_size_is_reached(spark):
    words = some_words(2, 800)
    alphabet = {c for w in words for c in w}
    trace = []
    vocab = train_unigram(table(spark, words), 4 + len(alphabet) + 20, em_rounds=4, trace=trace).collect()
    assert len(vocab) == 4 + len(alphabet) + 20
    assert [r.id for r in sorted(vocab, key=lambda r: r.id)] == list(range(len(vocab)))
    assert alphabet <= {r.piece for r in vocab}
    for (n, before), (m, after) in zip(trace, trace[1:]):
        assert n != m or after >= before - 1e-6 * abs(before)
    assert {"like", "ness", "ful"} <= {r.piece for r in vocab}
    assert math.isclose(sum(math.exp(r.score) for r in vocab if r.id >= 4), 1.0, rel_tol=1e-6)
    with pytest.raises(ValueError):
        train_unigram(table(spark, words), 10)


def test_seeds_are_bounded_by_a_higher_count(spark):
    words = some_words(3, 500)
    few = train_unigram(table(spark, words), 60, max_seeds=80).collect()
    assert len(few) == 60
    assert train_unigram(table(spark, {"": 3}), 10).count() == 4


def test_long_words_of_small_chances():
    """Chances too small for a float are summed by logarithms, others as they are; both give the same."""
    scores = {"a": -30.0, "b": -2.0, "ab": -31.0, "ba": -60.0}
    words = ["ab" * 40, "aab", "b", "", "ba" * 3]
    got, ll = expected_counts(Lattice(scores), *_words(pa.array(words)), np.array([1.0, 2.0, 3.0, 4.0, 5.0]))
    cells, at, size = unigram.lattice_cells(Lattice(scores), 2, *_words(pa.array(words)))
    want, likelihood = np.zeros(4), 0.0
    for i, c in ((0, 1.0), (1, 2.0), (2, 3.0), (4, 5.0)):
        cell = cells[at[i]:at[i + 1]].reshape(-1, 1)
        share, log_p = unigram._by_logs(cell, int(size[i]), min(int(size[i]), 2), unigram._weights(np.array(list(scores.values()))))
        np.add.at(want, cell[cell >= 0], share[cell >= 0] * c)
        likelihood += c * float(log_p[0])
    assert np.allclose(got, want) and math.isclose(ll, likelihood) and ll < -1000


def test_substrings_are_counted_by_one_shuffle(spark, monkeypatch):
    """No join and no table for each length, and words' lattices are looked up once for all rounds."""
    calls = []
    monkeypatch.setattr(unigram, "word_lattices", lambda *a, f=unigram.word_lattices: calls.append(1) or f(*a))
    monkeypatch.setattr(DataFrame, "join", None)
    words, trace = some_words(4, 400), []
    got = frequent_substrings(table(spark, words), 2, 16)
    assert got.count() and len(train_unigram(table(spark, words), 60, trace=trace).collect()) == 60
    assert len(calls) == 1 and len(trace) > 2


def test_equal_scores_are_ordered_by_piece():
    values = np.array([-10.3796, -10.3796 * (1 + 1e-14), np.inf, 3e6, 3e6 * (1 + 1e-14), 3e6 * (1 + 1e-8), 0.0])
    got = unigram._steady(values)
    assert got[0] == got[1] and got[3] == got[4] < got[5] and got[2] == np.inf and got[6] == 0
