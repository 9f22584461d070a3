"""Merges from the inverted index against training one by one."""

import random

import numpy as np
import pytest

from corpus_spark.operators import pair_index, vocab
from tests.test_ops import python_bpe


def test_replay_equals_one_merge_after_the_other():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        off = np.concatenate([[0], np.cumsum(rnd.integers(0, 14, rnd.integers(0, 12)))]).astype(np.int64)
        flat = rnd.integers(0, 3, off[-1]).astype(np.int32)
        merges = [(int(rnd.integers(0, 3 + i)), int(rnd.integers(0, 3 + i)), int(rnd.choice([3 + i, rnd.integers(0, 3 + i)])))
                  for i in range(rnd.integers(0, 12))]
        one, many = pair_index.merge_pairs(flat, off, merges), pair_index.replay(flat, off, merges)
        assert one[0].tolist() == many[0].tolist() and one[1].tolist() == many[1].tolist()


@pytest.mark.parametrize("bounds", [{}, {"top_pairs": 6, "epoch": 1000}, {"top_pairs": 30, "epoch": 9}])
def test_merges_equal_one_by_one(spark, bounds):
    # words of 90 letters are rows of their own
    rnd = random.Random(11)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 5, 9, 90]))): rnd.randrange(1, 40) for _ in range(50)}
    df = spark.createDataFrame(list(words.items()), "word string, count long")
    wanted = python_bpe(words, 40)
    assert vocab.train_bpe(df, 4 + len(set("".join(words))) + 40, **bounds)[1] == wanted


@pytest.mark.parametrize("bounds", [{}, {"top_pairs": 6}, {"top_pairs": 25, "epoch": 9}])
def test_symbols_spelled_twice(spark, bounds):
    # spelled in the order of letters, ab and ba become one symbol, whose pairs rise again
    def joined(a, b):
        return "".join(sorted(a + b))

    rnd = random.Random(5)
    freqs = {"".join(rnd.choice("abcd") for _ in range(rnd.choice([2, 5, 9, 20]))): rnd.randrange(1, 40) for _ in range(50)}
    words, wanted = {w: (tuple(w), c) for w, c in freqs.items()}, []
    for _ in range(40):
        pairs = {}
        for w, c in words.values():
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + c
        best = min((p for p in pairs if pairs[p] >= 2), key=lambda p: (-pairs[p], p))
        wanted.append(best)
        for k, (w, c) in words.items():
            out = []
            for s in w:
                # the right one of a pair that has just been made is not a left one
                if out and out[-1] == (best[0], 0) and s == best[1]:
                    out[-1] = (joined(*best), 1)
                else:
                    out.append((s, 0))
            words[k] = tuple(s for s, _ in out), c
    assert len({joined(*p) for p in wanted}) < len(wanted)
    names = list("abcd")
    df = spark.createDataFrame([([names.index(x) for x in w], c) for w, c in freqs.items()], "w array<int>, count long")
    assert pair_index.MergeLoop(df, names, joined, **bounds).run(40) == wanted


def test_pairs_run_out(spark):
    df = spark.createDataFrame([("ab", 5), ("cd", 1), ("e", 9), ("", 3)], "word string, count long")
    assert vocab.train_bpe(df, 100)[1] == [("a", "b")]
    assert vocab.train_bpe(df, 100, min_frequency=1)[1] == [("a", "b"), ("c", "d")]
    assert vocab.train_bpe(df.limit(0), 100)[1] == []


def test_round_reads_only_words_of_its_pairs(spark):
    words = spark.createDataFrame([([i % 50, 50 + i % 7, 100 + i], 1) for i in range(4000)], "w array<int>, count long")
    index = pair_index.PairIndex(words)
    table, _ = index._rows([pair_index.key_of(3, 53)])
    assert table.count() == sum(1 for i in range(4000) if i % 50 == 3 and i % 7 == 3)
    assert "PushedFilters: [Or(" in table._jdf.queryExecution().toString()
    got = {(r["key"] >> 32, r["key"] & 0xFFFFFFFF): r["d"]
           for r in index.changes([pair_index.key_of(3, 53)], [], [(3, 53, 9999)], 1, [])}
    held = [i for i in range(4000) if i % 50 == 3 and i % 7 == 3]
    assert got == {(3, 53): -len(held)} | {(53, 100 + i): -1 for i in held} | {(9999, 100 + i): 1 for i in held}


def test_linked_words_equal_merged_words():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        off = np.concatenate([[0], np.cumsum(rnd.integers(0, 14, rnd.integers(1, 12)))]).astype(np.int64)
        flat, count = rnd.integers(0, 3, off[-1]).astype(np.int32), rnd.integers(1, 9, len(off) - 1)
        merges = [(int(rnd.integers(0, 3 + i)), int(rnd.integers(0, 3 + i)), int(rnd.choice([3 + i, rnd.integers(0, 3 + i)])))
                  for i in range(8)]
        words = pair_index.LinkedWords(flat, off, count, merges)
        for merge in merges:
            before, made = totals(flat, off, count), words.merge(*merge)
            flat, off = pair_index.merge_pairs(flat, off, [merge])
            for key, d in zip(*(x.tolist() for x in made or (np.zeros(0), np.zeros(0)))):
                before[key] = before.get(key, 0) + d
            assert {k: n for k, n in before.items() if n} == totals(flat, off, count)


def totals(flat, off, count):
    out = {}
    for key, word in zip(*(x.tolist() for x in pair_index._pairs(flat, off))):
        out[key] = out.get(key, 0) + int(count[word])
    return out


def test_hot_pairs_need_no_index_and_few_rounds(spark, monkeypatch):
    """While most words hold the pairs that are merged, no index is written; a
    round makes merges of symbols that it has itself made."""
    words = {f"{a}{b}ing{c}": i + 2 for i, (a, b, c) in enumerate((a, b, c) for a in "klm" for b in "aou" for c in "stz")}
    names = sorted(set("".join(words)))
    df = spark.createDataFrame([([names.index(x) for x in w], c) for w, c in words.items()], "w array<int>, count long")
    loop = pair_index.MergeLoop(df, names, lambda a, b: a + b)
    assert loop.run(20) == python_bpe(words, 20)
    assert isinstance(loop.index, pair_index.WordScan) and loop.rounds <= 4
    monkeypatch.setattr(pair_index, "INDEX_SHARE", 0)
    loop = pair_index.MergeLoop(df, names, lambda a, b: a + b)
    assert loop.run(20) == python_bpe(words, 20)
    assert type(loop.index) is pair_index.PairIndex


@pytest.mark.parametrize("prefix", ["", "##"])
def test_alphabet_is_collected_in_the_scan(spark, prefix):
    df = spark.createDataFrame([("añb😀", 3), ("😀a", 1), ("", 2), ("b", 1), (None, 4)], "word string, count long")
    want = {w[0] for w in ("añb😀", "😀a", "b")} | {prefix + c for w in ("añb😀", "😀a", "b") for c in w[1:]}
    assert list(vocab.word_characters(df, prefix)) == sorted(want)
    pieces = {r.piece for r in vocab.train_bpe(df, 4 + len(want) + 1, continuing_prefix=prefix)[0].collect()}
    assert want < pieces
