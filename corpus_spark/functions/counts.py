"""Counts of equal characters or token n-grams of each document, by array
operations over Arrow batches: nothing is sorted or folded element by element
in an interpreted lambda.  Batches are taken in slices of bounded size (a
single longer document is a slice of its own)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Characters, or tokens, of a slice.
SLICE = 1 << 20


def _sizes(lengths: pa.Array) -> np.ndarray:
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, to
        at = to


def _rows(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _counts(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, value) that occurs: the row, and how often it does.
    Values are from 0 and below 2^40."""
    key = np.sort((row << 40) | value)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 40, np.diff(np.append(first, len(key)))


def _entropy(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Shannon entropy (bits) of each row's values; 0.0 for rows without any."""
    of, c = _counts(row, value)
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    h = np.log2(n) - np.bincount(of, weights=c * np.log2(c), minlength=rows) / n
    return np.maximum(h, 0.0)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many different values each row has."""
    return np.bincount(_counts(row, value)[0], minlength=rows)


def _grams(value: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of rows of ``size`` values on end: the row and a number of
    each.  Numbered anew at each step: a number stays below the values here."""
    per = np.maximum(size - (n - 1), 0)
    row = _rows(per)
    first = np.arange(len(row)) + ((np.cumsum(size) - size) - (np.cumsum(per) - per))[row]
    gram = value[first]
    for j in range(1, n):
        gram = np.unique((gram << 31) | value[first + j], return_inverse=True)[1]
    return row, gram


def _of_chars(texts: pa.Array, n: int, measure, kind) -> pa.Array:
    texts = pc.fill_null(texts, "")
    sizes, out = _sizes(pc.utf8_length(texts)), [np.zeros(0)]
    for a, b in _slices(sizes):
        codes = np.frombuffer("".join(texts[a:b].to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        out.append(measure(*_grams(codes, sizes[a:b], n), b - a))
    return pa.array(np.concatenate(out).astype(kind))


def _of_tokens(lists: pa.Array, n: int, measure, kind) -> pa.Array:
    sizes, out = _sizes(pc.list_value_length(lists)), [np.zeros(0)]
    for a, b in _slices(sizes):
        words = lists[a:b].flatten().dictionary_encode(null_encoding="encode").indices
        words = words.to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(measure(*_grams(words, sizes[a:b], n), b - a))
    return pa.array(np.concatenate(out).astype(kind))


def char_entropy(text: Column) -> Column:
    """Entropy of the characters (code points) of a text; 0.0 without any."""
    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return _of_chars(texts, 1, _entropy, np.float64)
    return run(text)


def token_entropy(tokens: Column, n: int = 1) -> Column:
    """Entropy of the n-grams of consecutive tokens; 0.0 without any."""
    @arrow_udf("double")
    def run(lists: pa.Array) -> pa.Array:
        return _of_tokens(lists, n, _entropy, np.float64)
    return run(tokens)


def distinct_char_ngrams(text: Column, n: int) -> Column:
    """Different n-grams of characters (code points) of a text."""
    @arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return _of_chars(texts, n, _distinct, np.int64)
    return run(text)


def distinct_token_ngrams(tokens: Column, n: int) -> Column:
    """Different n-grams of consecutive tokens."""
    @arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        return _of_tokens(lists, n, _distinct, np.int64)
    return run(tokens)
