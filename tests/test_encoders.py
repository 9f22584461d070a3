import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_spark.operators.encoders import (UNKNOWN_PENALTY, Unigram, WordPiece, decode_pieces, encode_unigram,
                                             encode_wordpiece)

ALPHABET = "abcé\U0001F600"


def plain_wordpiece(word, first, rest, unk, max_chars=100):
    if len(word) > max_chars:
        return [unk]
    out, at = [], 0
    while at < len(word):
        table = rest if at else first
        for end in range(len(word), at, -1):
            if word[at:end] in table:
                out.append(table[word[at:end]])
                at = end
                break
        else:
            return [unk]
    return out


def plain_unigram(word, scores):
    """(score, pieces) of the best path; of equal ones that with the longest last piece."""
    unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            s = scores.get(piece, unknown if end - start == 1 else None)
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                best[end] = (best[start][0] + s, best[start][1] + [piece])
    return best[-1]


def plain_unigram_ids(word, ids, scores, unk):
    out = []
    for p in plain_unigram(word, scores)[1]:
        if p in ids or not out or out[-1] != unk:
            out.append(ids.get(p, unk))
    return out


def split(ids, counts):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at:at + n].tolist())
        at += n
    return out


texts = st.text(alphabet=ALPHABET, min_size=0, max_size=9)
some_pieces = st.sets(st.text(alphabet=ALPHABET, min_size=1, max_size=4), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6, unique=True), some_pieces, some_pieces)
def test_wordpiece_equals_plain_python(words, first, rest):
    first = {p: 10 + i for i, p in enumerate(sorted(first))}
    rest = {p: 100 + i for i, p in enumerate(sorted(rest))}
    got = split(*WordPiece(first, rest, 1, 7).encode(pa.array(words, pa.string())))
    assert got == [plain_wordpiece(w, first, rest, 1, 7) for w in words]


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6, unique=True), some_pieces, st.randoms(use_true_random=False))
def test_unigram_equals_plain_python(words, pieces, rnd):
    ids = {p: 5 + i for i, p in enumerate(sorted(pieces))}
    scores = {p: -float(rnd.randint(1, 4)) for p in ids}  # many ties
    got = split(*Unigram(ids, scores, 1).encode(pa.array(words, pa.string())))
    assert got == [plain_unigram_ids(w, ids, scores, 1) for w in words]


def test_documents(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 30))))
            for i in range(60)] + [(60, None), (61, ""), (62, "a" * 5000), (63, "<unk> zz")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, input_ids string, words int")
    pieces = ["<pad>", "<unk>"] + list("abcde") + ["ab", "abc", "de", "##", "##a", "##b", "##c", "##cd", "##de", "##e"]
    vocab = spark.createDataFrame([(p, i, -1.5 * len(p) - i / 7) for i, p in enumerate(pieces)], "piece string, id long, score double")
    special = ["<pad>", "<unk>"]
    first = {p: i for i, p in enumerate(pieces) if p not in special and not p.startswith("##")}
    rest = {p[2:]: i for i, p in enumerate(pieces) if p.startswith("##") and len(p) > 2}
    scores = {p: -1.5 * len(p) - i / 7 for i, p in enumerate(pieces) if p not in special}
    ids = {p: i for i, p in enumerate(pieces) if p not in special}
    for out, plain in ((encode_wordpiece(df, vocab, specials=special), lambda w: plain_wordpiece(w, first, rest, 1)),
                       (encode_unigram(df, vocab, specials=special),
                        lambda w: plain_unigram_ids(w, ids, scores, 1) if len(w) < 100 else None)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r for r in out.collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            words = re.findall(r"\w+|[^\w\s]+", t or "")
            want = [(x, n) for n, w in enumerate(words) for x in (plain(w) or [])]
            if plain("a" * 100) is None and i == 62:
                assert len(got[i].input_ids) == 5000
            else:
                assert list(zip(got[i].input_ids, got[i].word_ids)) == want
    assert encode_unigram(df.limit(0), vocab).count() == 0


def test_decoders(spark):
    cases = [("metaspace", ["▁the", "▁old", "er", "▁mill"], "the older mill"), ("bpe", ["th", "e</w>", "mill</w>"], "the mill"),
             ("wordpiece", ["the", "old", "##er", "mill"], "the older mill"), ("byte_level", ["the", " old", "er"], "the older")]
    for kind, pieces, want in cases:
        df = spark.createDataFrame([(pieces,), ([],)], "p array<string>").coalesce(1)
        assert [r[0] for r in df.select(decode_pieces(F.col("p"), kind)).collect()] == [want, ""]
    with pytest.raises(ValueError):
        decode_pieces(F.col("p"), "other")
