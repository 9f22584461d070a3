"""The trigram model in blocks against plain Python."""

import collections
import glob
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_spark.functions.text import tokenize
from corpus_spark.llm.common import text_buffer
from corpus_spark.operators import lm, ngram_blocks as blocks

ODD = ["The cat's 1,5 €… x_y", "", None, "ΣΑΣ İx 😀😀 áb ‍‿ ٣٤", " \x85\xa0　\x1c\x00", "日本語。テスト", "é", "--", "<s> <s>",
       " a  b ", "𝒳𝒴𐐷 \U0001F469‍\U0001F52C ﷺ", "a­b ﻿c"]


def test_tokens_of_bytes_equal_the_regex(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    want = [r.k or [] for r in df.select("id", tokenize("text").alias("k")).orderBy("id").collect()]
    buf, offsets = text_buffer(pa.array(ODD, pa.string()))
    starts, ends, first = blocks.token_spans(buf, offsets, blocks.token_classes(spark))
    got = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [got[first[i]:first[i + 1]] for i in range(len(ODD))] == want


def losses(train, docs):
    """Of rows (id, tokens), by id, as the model is described."""
    def grams(k):
        k = ["<s> ", "<s> "] + k
        return list(zip(k, k[1:], k[2:]))
    tri, bi, uni, two, one = (collections.Counter() for _ in range(5))
    for _, k in train:
        for u, v, w in grams(k):
            tri[u, v, w] += 1
            two[u, v] += 1
            bi[v, w] += 1
            one[v] += 1
            uni[w] += 1
    z = sum(uni.values()) + len(uni) + 1
    out = collections.defaultdict(list)
    for i, k in docs:
        for u, v, w in grams(k):
            p = tri[u, v, w] / two[u, v] if tri[u, v, w] else 0.4 * bi[v, w] / one[v] if bi[v, w] else 0.16 * (uni[w] + 1) / z
            out[i].append(-math.log(p))
    return {i: (pytest.approx(sum(x) / len(x)), len(x)) for i, x in out.items()}


@pytest.mark.parametrize("chars", [64 << 20, 40])
def test_losses_equal_plain_counts(spark, monkeypatch, chars):
    """In one round and in several; trigrams, bigrams and tokens that the model lacks; ids that repeat or lack."""
    monkeypatch.setattr(blocks, "ROUND_CHARS", chars)
    monkeypatch.setattr(blocks, "SHARD_CHARS", chars)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 40)))) for i in range(30)] + list(enumerate(ODD, 25)) \
        + [(None, "a b c"), (None, "new words, a"), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    known = df.withColumn("k", F.coalesce(tokenize("text"), F.array().cast("array<string>"))).collect()
    every = [(r.id, r.k) for r in known]
    half = df.filter("id % 2 = 0")
    models = [(half, [(r.id, r.k) for r in known if r.id is not None and r.id % 2 == 0]), (df, every), (df.limit(0), [])]
    for train, model in models[:1] if chars == 40 else models:
        got = {r.id: (r.loss, r.n_tokens) for r in lm.token_losses(df, lm.train_trigram_lm(train)).collect()}
        assert got == losses(model, every)


def test_tables_look_up_edges():
    key = np.array([0, 1, 5, 2**63, 2**64 - 1], np.uint64)
    asked = np.array([2**64 - 1, 0, 2, 2**63 + 1, 5, 1], np.uint64)
    assert blocks.Table(key).find(asked).tolist() == [4, 0, -1, -1, 2, 1]
    assert blocks.Table(key[:0]).find(asked).tolist() == [-1] * 6


def test_scoring_leaves_no_shuffled_tokens_on_disk(spark):
    """A few bytes a token of shuffle files are left; a row for each trigram would leave more than twenty."""
    rnd = random.Random(5)
    n = 150_000
    rows = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(n // 30))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    used = lambda: sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data"))
    before = used()
    assert lm.token_losses(df, lm.train_trigram_lm(df)).agg(F.sum("n_tokens")).first()[0] == n
    assert used() - before < 5 * n
