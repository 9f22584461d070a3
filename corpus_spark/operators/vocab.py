"""Tokenizer vocabulary work as Spark jobs.

The data-heavy part of training a subword tokenizer is counting over the
corpus; merges then run over the *distinct-word table* (a DataFrame, far
smaller than the corpus but still distributed):

* :func:`normalize_text` / :func:`pretokenize` -- text to words;
* :func:`word_frequencies` -- ``(word, count)``, the trainers' input;
* :func:`train_bpe` -- byte-pair merges: the most frequent adjacent pair
  (weighted by word frequency; ties: lexicographically smallest first) becomes
  a symbol; words are found by an inverted index of pairs (:mod:`.pair_index`);
  ``continuing_prefix="##"`` gives WordPiece-style pieces;
* :func:`encode_words` -- apply the merges to each distinct word once;
  :func:`encode_corpus` -- encode documents inside the scan, without a shuffle;
* :func:`merge_vocabularies`, :func:`special_tokens_table`.
"""

from __future__ import annotations

import math
import unicodedata
from typing import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .pair_index import EPOCH, TOP_PAIRS, MergeLoop, merge_pairs  # noqa: F401  (part of this module's interface)
from .rowindex import group_row_index

# ---------------------------------------------------------------------------
# What the ``nmt`` normalizer drops, and what it makes a blank
# ---------------------------------------------------------------------------
NMT_DROPPED = r"[\x{1}-\x{8}\x{B}\x{E}-\x{1F}\x{7F}\x{8F}\x{9F}]"
NMT_BLANK = r"[\x{9}\x{A}\x{C}\x{D}\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]"

# ---------------------------------------------------------------------------
# Special tokens and their reserved ids
# ---------------------------------------------------------------------------
DEFAULT_SPECIALS = {"pad_token": "<pad>", "unk_token": "<unk>", "bos_token": "<s>", "eos_token": "</s>"}
RESERVED_ORDER = ("pad_token", "unk_token", "bos_token", "eos_token")

PRETOKENIZERS = {
    # word runs or runs of other non-space characters
    "whitespace": r"(?U)\w+|[^\w\s]+",
    # anything between white space
    "whitespace_split": r"(?U)\S+",
    # punctuation characters on their own, the rest between them
    "punctuation": r"\p{P}|[^\p{P}]+",
    # every digit on its own
    "digits": r"\p{Nd}|[^\p{Nd}]+",
    # words, numbers and other signs with the blank before them (GPT-2 rule)
    "byte_level": r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    # white space removed, every punctuation or ASCII sign on its own
    "bert": r"(?U)[\p{P}!-/:-@\[-`{-~]|[^\s\p{P}!-/:-@\[-`{-~]+",
}

_SHARED = r"\p{IsCommon}\p{IsInherited}"
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han}\\p{IsHiragana}\\p{IsKatakana", "Hangul", "Arabic", "Hebrew", "Devanagari",
            "Bengali", "Tamil", "Telugu", "Thai", "Ethiopic", "Georgian", "Armenian")
# a run of one script (Han with the kana); characters that scripts share go with the run before them
PRETOKENIZERS["unicode_scripts"] = (
    f"[{_SHARED}]*(?:" + "|".join(f"[\\p{{Is{x}}}][\\p{{Is{x}}}{_SHARED}]*" for x in _SCRIPTS)
    + f"|[^{_SHARED}]+)|[{_SHARED}]+")


@F.pandas_udf(T.StringType())
def _unicode_normalize_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _unicode_normalize_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _unicode_normalize_nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(T.StringType())
def _unicode_normalize_nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


_UNICODE_FORMS = {"nfc": _unicode_normalize_nfc, "nfkc": _unicode_normalize_nfkc,
                  "nfd": _unicode_normalize_nfd, "nfkd": _unicode_normalize_nfkd}


def normalize_text(text: Column, steps: Sequence) -> Column:
    """Apply normalisation steps in order.  A step is a name
    (``nfc nfd nfkc nfkd lowercase strip nmt bert``) or a tuple
    (``("replace", pattern, content)``, ``("prepend", s)``).  Unicode forms
    run in an Arrow ``pandas_udf`` (the JVM has no NFC function); every other
    step is a native expression."""
    out = text
    for st in steps:
        name = st if isinstance(st, str) else st[0]
        if name in _UNICODE_FORMS:
            out = _UNICODE_FORMS[name](out)
        elif name == "lowercase":
            out = F.lower(out)
        elif name == "strip":
            out = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
        elif name == "nmt":
            out = F.regexp_replace(F.regexp_replace(out, NMT_DROPPED, ""), NMT_BLANK, " ")
        elif name == "replace":
            out = F.regexp_replace(out, st[1], st[2])
        elif name == "prepend":
            out = F.concat(F.lit(st[1]), out)
        elif name == "bert":
            # clean control characters, put spaces around CJK, lowercase, strip accents
            out = F.regexp_replace(out, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
            out = F.regexp_replace(out, r"(\p{IsHan})", " $1 ")
            out = F.lower(out)
            out = F.regexp_replace(_UNICODE_FORMS["nfd"](out), r"\p{Mn}", "")
        else:
            raise ValueError(f"Unknown normalizer: {name}")
    return out


def pretokenize(text: Column, steps: Sequence[str] = ("whitespace",)) -> Column:
    """Split text into words with one or more pre-tokenizers applied in turn
    (each splits every piece produced by the previous one).  ``metaspace``
    replaces spaces by U+2581 and splits before each of them; a step
    ``("split", pattern)`` takes what lies between matches of a pattern."""
    pieces = F.array(text)
    for st in steps:
        if st == "metaspace":
            pieces = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(
                F.regexp_replace(F.concat(F.lit(" "), p), " ", "▁"), F.lit("▁[^▁]*"), 0)))
        elif isinstance(st, (tuple, list)) and len(st) == 2 and st[0] == "split":
            pieces = F.filter(F.flatten(F.transform(pieces, lambda p: F.split(p, st[1], -1))), lambda p: p != "")
        elif st in PRETOKENIZERS:
            pat = PRETOKENIZERS[st]
            pieces = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(pat), 0)))
        else:
            raise ValueError(f"Unknown pre-tokenizer: {st}")
    return pieces


def word_frequencies(df: DataFrame, text_col: str = "text", pre: Sequence[str] = ("whitespace",),
                     normalizers: Sequence = ()) -> DataFrame:
    """``(word, count)`` over the corpus: explode + partial aggregation."""
    t = normalize_text(F.col(text_col), normalizers) if normalizers else F.col(text_col)
    return (df.select(F.explode(pretokenize(t, pre)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("count")))


def special_tokens_table(spark, specials: dict | None = None) -> DataFrame:
    """Reserved vocabulary rows: pad=0, unk=1, bos=2, eos=3, then any other
    user-defined special tokens.  pad and unk are mandatory."""
    sp = dict(DEFAULT_SPECIALS)
    sp.update(specials or {})
    for req in ("pad_token", "unk_token"):
        if not sp.get(req):
            raise ValueError(f"{req} is mandatory")
    order = [k for k in RESERVED_ORDER if k in sp] + sorted(k for k in sp if k not in RESERVED_ORDER)
    rows = [(sp[k], i, k) for i, k in enumerate(order)]
    return spark.createDataFrame(rows, "piece string, id long, role string")


def resolve_vocab_size(vocab_size: int | str, corpus: DataFrame | None, text_col: str = "text") -> int:
    """A number of pieces; ``"auto"`` predicts it from the corpus' characters."""
    if vocab_size == "auto":
        if corpus is None:
            raise ValueError("vocab_size 'auto' needs the corpus")
        from .stats import predict_vocab_size
        return int(predict_vocab_size(corpus, text_col=text_col).first()["vocab_size"])
    if not isinstance(vocab_size, int) or isinstance(vocab_size, bool) or vocab_size < 1:
        raise ValueError(f"vocab_size must be a positive number or 'auto', not {vocab_size!r}")
    return vocab_size


def _characters(words: pa.Array, marked: bool) -> tuple[np.ndarray, np.ndarray]:
    """All characters of words, as twice the code point (``marked``: one more
    for those that do not begin a word), and where each word begins."""
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64) * 2
    if marked:
        codes += 1
        codes[off[:-1][np.diff(off) > 0]] -= 1
    return codes, off


def word_characters(freqs: DataFrame, continuing_prefix: str = "") -> dict[str, int]:
    """The alphabet of ``freqs`` (word, ...), in order: names of characters
    (``continuing_prefix`` before those that do not begin a word) and their
    numbers in :func:`_characters`.  Characters are collected inside the scan."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_characters(batch.column(0), bool(continuing_prefix))[0]))],
                                             names=["c"])

    found = freqs.filter(F.length("word") > 0).select("word").mapInArrow(run, "c long").distinct().collect()
    return dict(sorted((continuing_prefix * (r["c"] & 1) + chr(r["c"] >> 1), r["c"]) for r in found))


def train_bpe(freqs: DataFrame, vocab_size: int | str, specials: dict | None = None,
              continuing_prefix: str = "", min_frequency: int = 2, corpus: DataFrame | None = None,
              top_pairs: int = TOP_PAIRS, epoch: int = EPOCH):
    """Train byte-pair merges on a ``(word, count)`` table.

    Words are arrays of symbol numbers.  All pairs are counted once for each
    ``epoch`` merges; between, a round reads from an inverted index only the
    words that hold the pairs it merges (:mod:`.pair_index`).  The merges are
    those of training one by one; ``top_pairs`` and ``epoch`` only change how
    often the index is written.
    ``vocab_size`` may be ``"auto"`` (then ``corpus`` has the texts); a size
    that the characters do not fit in is an error.

    Returns ``(vocab DataFrame (piece, id), merges list[(a, b)])``.  The
    alphabet is every character seen; with ``continuing_prefix`` (``##``)
    non-initial pieces carry the prefix (WordPiece style)."""
    spark = freqs.sparkSession
    vocab_size = resolve_vocab_size(vocab_size, corpus)
    split = freqs.filter(F.length("word") > 0).select("word", F.col("count").cast("long").alias("count"))
    characters = word_characters(freqs, continuing_prefix)
    alphabet = list(characters)
    specials_df = special_tokens_table(spark, specials)
    n_special = specials_df.count()
    budget = vocab_size - n_special - len(alphabet)
    if budget < 0:
        raise ValueError(f"vocab_size {vocab_size} is too small: {n_special} special tokens and "
                         f"{len(alphabet)} characters need {n_special + len(alphabet)}")
    names = list(alphabet)
    known = np.array(list(characters.values()), np.int64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], order.astype(np.int32)))  # the alphabet

    def to_numbers(batches):
        for batch in batches:
            codes, off = _characters(batch.column(0), bool(continuing_prefix))
            flat = shared.value[1][np.searchsorted(shared.value[0], codes)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat)),
                                              batch.column(1)], names=["w", "count"])

    words = written(split.mapInArrow(to_numbers, "w array<int>, count long").filter(F.size("w") > 1), "bpe-words")

    def joined(a, b):
        return a + (b[len(continuing_prefix):] if continuing_prefix and b.startswith(continuing_prefix) else b)

    merges = MergeLoop(words, names, joined, min_frequency, top_pairs, epoch).run(budget)
    pieces = alphabet + [joined(a, b) for a, b in merges]
    seen, ordered = set(), []
    for p in pieces:
        if p not in seen:
            seen.add(p)
            ordered.append(p)
    base = [(p, n_special + i) for i, p in enumerate(ordered)]
    vocab = specials_df.select("piece", "id").unionByName(spark.createDataFrame(base, "piece string, id long"))
    return vocab, merges


def _bpe_encode_word(word: str, ranks: dict, prefix: str) -> list[str]:
    syms = list(word)
    if prefix:
        syms = syms[:1] + [prefix + c for c in syms[1:]]
    while len(syms) > 1:
        best, best_i = None, -1
        for i in range(len(syms) - 1):
            r = ranks.get((syms[i], syms[i + 1]))
            if r is not None and (best is None or r < best):
                best, best_i = r, i
        if best is None:
            break
        a, b = syms[best_i], syms[best_i + 1]
        m = a + (b[len(prefix):] if prefix and b.startswith(prefix) else b)
        out, i = [], 0
        while i < len(syms):
            if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                out.append(m)
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def encode_words(words: DataFrame, merges: list, vocab: DataFrame, continuing_prefix: str = "",
                 unk_id: int = 1) -> DataFrame:
    """Encode each distinct word once: ``(word, pieces, ids)``.  Per-word BPE
    runs in Arrow batches with the merge ranks broadcast (bounded by the
    vocabulary size); piece ids come from a broadcast join with the vocab."""
    spark = words.sparkSession
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    b_ranks = spark.sparkContext.broadcast(ranks)
    prefix = continuing_prefix

    def enc(batches):
        r = b_ranks.value
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"],
                                "pieces": [_bpe_encode_word(w, r, prefix) for w in pdf["word"]]})

    enc_df = words.select("word").distinct().mapInPandas(enc, "word string, pieces array<string>")
    ex = enc_df.select("word", F.posexplode("pieces").alias("pos", "piece"))
    # vocabulary size is bounded by the training parameter: broadcast
    j = ex.join(F.broadcast(vocab.select("piece", "id")), "piece", "left") \
        .withColumn("id", F.coalesce("id", F.lit(unk_id)))
    return j.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "id"))).alias("s")) \
        .select("word", F.transform("s", lambda x: x["piece"]).alias("pieces"),
                F.transform("s", lambda x: x["id"]).alias("ids"))


def encode_corpus(df: DataFrame, merges: list, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
                  pre: Sequence[str] = ("whitespace",), continuing_prefix: str = "", unk_id: int = 1) -> DataFrame:
    """``(id, input_ids, word_ids)``, inside the scan: words are cut natively,
    the distinct words of an Arrow batch are encoded once, nothing is
    shuffled.  Merges and piece ids are broadcast; both are as many as the
    vocabulary size that was asked for."""
    spark = df.sparkSession
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    ids = {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect()}
    shared = spark.sparkContext.broadcast((ranks, ids))

    def enc(batches):
        r, known = shared.value
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            out_ids, out_words = [], []
            for words in pdf["words"]:
                one, at = [], []
                for i, w in enumerate(words if words is not None else ()):
                    if w not in seen:
                        seen[w] = [known.get(p, unk_id) for p in _bpe_encode_word(w, r, continuing_prefix)]
                    one += seen[w]
                    at += [i] * len(seen[w])
                out_ids.append(one)
                out_words.append(at)
            yield pd.DataFrame({id_col: pdf[id_col], "input_ids": out_ids, "word_ids": out_words})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, pretokenize(F.col(text_col), pre).alias("words")).mapInPandas(
        enc, f"`{id_col}` {kind}, input_ids array<long>, word_ids array<int>")


def merge_vocabularies(base: DataFrame, extra: DataFrame, specials: Iterable[str] = ()) -> DataFrame:
    """Append the pieces of ``extra`` missing from ``base`` (ids continue after
    base's maximum, in extra's id order); special tokens only when missing."""
    missing = extra.join(base.select("piece"), "piece", "left_anti")
    top = base.agg(F.max("id")).first()[0]
    top = -1 if top is None else top
    idx = group_row_index(missing.select("id", "piece"), None, ["id", "piece"], "r")
    added = idx.select("piece", (F.col("r") + F.lit(top + 1)).cast("long").alias("id"))
    out = base.select("piece", "id").unionByName(added)
    sp = [s for s in specials]
    if sp:
        have = {r[0] for r in out.filter(F.col("piece").isin(*sp)).select("piece").collect()}
        new = [s for s in sp if s not in have]
        if new:
            nxt = out.agg(F.max("id")).first()[0] + 1
            out = out.unionByName(out.sparkSession.createDataFrame(
                [(s, nxt + i) for i, s in enumerate(new)], "piece string, id long"))
    return out
