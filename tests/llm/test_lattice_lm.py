import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from corpus_spark.llm import lattice_lm
from corpus_spark.llm.lattice_lm import Lattice, Pieces, fit, op3_lattice_lm, score_texts

from .conftest import HARD_TEXTS

PATH = P.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def lattice():
    pieces = Pieces(PATH)
    p = np.concatenate((pieces.start, [0.001, 0.01]))
    return Lattice(pieces, np.log(p / p.sum()))


def spell(lattice, word):
    """``(probability, expected uses)`` over all segmentations, one by one."""
    p = {t: math.exp(lattice.log_p[i]) for i, t in enumerate(lattice.pieces.text)}
    byte = math.exp(lattice.log_p[-2]) / 256
    chars = ["▁"] + [c if c != "▁" else None for c in word]
    total, uses = 0.0, Counter()

    def go(i, weight, used):
        nonlocal total
        if i == len(chars):
            total += weight
            for u in used:
                uses[u] += weight
            return
        for j in range(i + 1, min(len(chars), i + 16) + 1):
            if None not in chars[i:j] and (t := "".join(chars[i:j])) in p:
                go(j, weight * p[t], used + [t])
        n = len((chars[i] or "▁").encode())
        go(i + 1, weight * byte**n, used + ["<byte>"] * n)
    go(0, 1.0, [])
    return total, {k: v / total for k, v in uses.items()}


def test_all_segmentations(lattice):
    words = ["the", "thing", "a", "über", "中x", "x▁y", "\U0001F600", "zq"]
    got = lattice.score(words)
    for w, g in zip(words, got):
        assert math.isclose(math.exp(g), spell(lattice, w)[0], rel_tol=1e-9)
    want = Counter()
    for n, w in enumerate(words, 1):
        for k, v in spell(lattice, w)[1].items():
            want[k] += n * v
    uses = lattice.expected(words, np.arange(1, len(words) + 1, dtype=float))
    for i, t in enumerate(lattice.pieces.text):
        assert math.isclose(uses[i], want.get(t, 0), rel_tol=1e-6, abs_tol=1e-12)
    assert math.isclose(uses[-2], want["<byte>"], rel_tol=1e-6)


def test_long_words(lattice):
    w = "thing" * 3000
    (a,) = lattice.score([w])
    assert np.isfinite(a) and abs(a / 3000 - lattice.score(["thing" * 30])[0] / 30) < 0.5


def base(docs):
    low = {c: c + 32 for c in range(65, 91)}
    words = [WORD.findall((t or "").translate(low)) for _, t in docs]
    held = [d is None or zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    c, ends = Counter(), 0
    for w, h in zip(words, held):
        if not h:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for (d, _), w, h in zip(docs, words, held):
        counts = [c[x] for x in w] + [ends]
        out.append((d, h, len(counts), sum(x > 0 for x in counts), n,
                    sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts)))
    return out


def check(rows, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    rows, want = sorted(map(tuple, rows), key=key), sorted(base(docs), key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9)
    return rows


@pytest.mark.parametrize("common", [0, 3, 1 << 19])
def test_hard_texts(spark, common, monkeypatch):
    monkeypatch.setattr(lattice_lm, "MAX_WORDS", 10)
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "null id"), (3, "again one"), (3, "again one")]
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in docs], "doc_id long, text string, row int, c int")
    rows = check(score_texts(df, PATH, common_words=common).collect(), docs)
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in rows)
    assert score_texts(df.limit(0), PATH, common_words=common).count() == 0


def test_fitting_raises_the_likelihood(spark):
    df = spark.createDataFrame([("theatre", 50), ("thing", 30), ("zzqx", 1)], "word string, c long")
    def total(rounds):
        lattice = Lattice(Pieces(PATH), fit(df, 10, PATH, rounds, smoothing=1e-3))
        return lattice.score(["theatre", "thing", "zzqx"]) @ [50, 30, 1] + 10 * lattice.end
    assert total(0) < total(1) < total(3)


def test_query_and_held_out_likelihood(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows = check(op3_lattice_lm(spark, d).collect(), docs)
    def per_token(found, held):
        return sum(r[6] for r in found if r[1] == held) / sum(r[2] for r in found if r[1] == held)
    # fitted weights say more of held-out texts than those of the file's ranks, and nearly as much as of the others
    first = [tuple(r) for r in score_texts(spark.read.parquet(f"{d}/documents.parquet"), PATH, rounds=0).collect()]
    assert per_token(rows, True) > per_token(first, True) + 0.05
    assert abs(per_token(rows, True) - per_token(rows, False)) < 0.1 * abs(per_token(rows, False))
