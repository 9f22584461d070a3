"""Periodic runs of words: stretches that repeat a short sequence of words.

A run is a stretch of consecutive words with a smallest period that cannot be
extended by a neighbouring word.  Runs are found as maximal pairs.  The
suffixes of a text's words are put in order by prefix doubling, the longest
common prefixes of neighbours in that order are computed, and the tree of LCP
intervals is walked bottom-up.  An interval of LCP ``l`` has the positions at
which the same ``l`` words stand; two of them from different children are
followed by different words, and if their classes, the words to their left,
differ as well, they are a maximal pair: the stretch from the one to the end of
the other's ``l`` words has their distance as a period and ends on either side.
The pairs whose distance is short enough for the wanted exponent are therefore
the runs; nothing has to be extended.

The class lists of an interval are kept merged in one list ordered by position,
each position with the class of its left word.  A run's pair stands next to
each other in that list (a position between them would be a shorter period),
so joining a child's list to the others (the shorter one is looked up in the
longer one) looks at the two neighbours of each position only, and does not
enumerate pairs that are too far apart or have the same left word.  A stretch
that pairs at several distances keeps the least one.

A text is one row and is worked off whole in one task; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hash_spans, mix64, slices, text_buffer, word_spans

MIN_LENGTH = 6
MIN_EXPONENT = 4


def least_overlap(min_length: int, min_exponent: int) -> int:
    """The least LCP that a pair of any distance needs to be a run."""
    return min(max((min_exponent - 1) * p, min_length - p) for p in range(1, min_length + 1))


def repeated_suffixes(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, numbers, text)``: the suffixes, in order of text and
    words, that share at least their first words (the largest power of two up
    to ``least`` of them) with another suffix of the same text.  ``words``:
    keys of the words of all texts on end, ``first``: each text's first word;
    ``numbers``: a number for each word that is its own within its text;
    ``text``: the text of each position returned."""
    n = len(words)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(first[1:], counts)
    order = np.lexsort((words, text))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    begin = np.flatnonzero(new)
    rank = np.empty(n, np.int64)  # where the class of equal beginnings starts in the final order
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    numbers = rank.copy()
    active = order[np.repeat(np.diff(np.append(begin, n)), np.diff(np.append(begin, n))) > 1]
    tied, size = active, 1
    while len(active):
        after = active + size
        inside = after < end[active]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        old = rank[active]
        start = np.ones(len(active), bool)
        start[1:] = old[1:] != old[:-1]
        new = start.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(active)))
        shift = at[group] - np.maximum.accumulate(np.where(start, at, 0))[group]
        rank[active] = np.repeat(old[group] + shift, sizes)
        active = active[np.repeat(sizes, sizes) > 1]
        size *= 2
        if size <= least:
            tied = active
    tied = tied[np.argsort(rank[tied])]
    return tied, numbers, text[tied]


def common_prefixes(words: list[int], order: list[int], least: int) -> list[int]:
    """Longest common prefix of each suffix in ``order`` with the one before
    it (0 for the first).  In text order a suffix shares at least one word less
    than the suffix before it, so no word is compared again and again;
    prefixes below ``least``, whose neighbours may not be in ``order``, are
    compared from their first word."""
    n = len(words)
    before = dict(zip(order[1:], order))
    found: dict[int, int] = {}
    length, last = 0, -2
    for i in sorted(before):
        length = length - 1 if i == last + 1 and length > least else 0
        last = i
        j = before[i]
        most = n - max(i, j)
        while length < most and words[i + length] == words[j + length]:
            length += 1
        found[i] = length
    return [0] + [found[i] for i in order[1:]]


def maximal_pairs(words: list[int], order: list[int], lcp: list[int], min_length: int,
                  min_exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period), by start and period, from the suffixes
    ``order`` and their common prefixes with the one before."""
    least = least_overlap(min_length, min_exponent)
    left = [-1] + words  # left[i]: the word before word i
    found: dict[tuple[int, int], int] = {}
    times = min_exponent - 1

    def pair(i: int, j: int, length: int) -> None:
        p = j - i
        if times * p <= length and p + length >= min_length and left[i] != left[j]:
            key = (i, p + length)
            if found.get(key, p) >= p:
                found[key] = p

    def join(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            at = bisect(a, x)
            if at:
                pair(a[at - 1], x, length)
            if at < len(a):
                pair(x, a[at], length)
        if len(b) == 1:
            a.insert(bisect(a, b[0]), b[0])
        else:
            a += b
            a.sort()
        return a

    open_: list[list] = []  # intervals that may still grow: [lcp, positions], lcp rising
    for k, at in enumerate(order):
        length = lcp[k + 1] if k + 1 < len(order) else 0
        positions = [at]
        while open_ and open_[-1][0] > length:
            depth, others = open_.pop()
            positions = join(others, positions, depth)
        if length < least:
            continue  # no interval above can hold a run
        if open_ and open_[-1][0] == length:
            open_[-1][1] = join(open_[-1][1], positions, length)
        else:
            open_.append([length, positions])
    return sorted(((start, length, p) for (start, length), p in found.items()), key=lambda r: (r[0], r[2]))


def find_runs(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each text that has any; ``words``, ``first`` as in
    :func:`repeated_suffixes`."""
    least = least_overlap(min_length, min_exponent)
    order, numbers, text = repeated_suffixes(words, first, least)
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    out = {}
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(text)).tolist()):
        i = int(text[a])
        own = numbers[first[i]:first[i + 1]].tolist()
        suffixes = (order[a:b] - first[i]).tolist()
        runs = maximal_pairs(own, suffixes, common_prefixes(own, suffixes, least), min_length, min_exponent)
        if runs:
            out[i] = runs
    return out


RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored):
    doc_id, runs (by start, then period; words are numbered from 0) and
    collapsed, the words joined by one blank without those that a run holds
    after its first period.

    A run has at least ``min_length`` words and ``min_exponent`` periods (2 or
    more).  Null, empty and blank texts have no words, no runs and an empty
    collapsed text; null and repeated doc_ids are kept as they are; an empty
    table gives an empty one.  A text's words are told apart by 64-bit hashes;
    a text of any length is worked off whole.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has at least one word and two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, offsets = text_buffer(part.column(1))
                starts, ends, first = word_spans(buf, offsets)
                runs = find_runs(mix64(hash_spans(buf, starts, ends)), first, min_length, min_exponent)
                keep = np.ones(len(starts), bool)
                for i, found in runs.items():
                    for start, length, p in found:
                        keep[first[i] + start + p:first[i] + start + length] = False
                raw = buf.tobytes()
                texts = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    kept = a + np.flatnonzero(keep[a:b])
                    texts.append(b" ".join([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())]).decode())
                flat = [r for i in range(part.num_rows) for r in runs.get(i, ())]
                at = np.cumsum([0] + [len(runs.get(i, ())) for i in range(part.num_rows)])
                struct = pa.StructArray.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)],
                                                    names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), struct), pa.array(texts, pa.string())],
                    names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


# --- the registered query -----------------------------------------------------------

def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a period in every tenth text: where h, the crc32
    of the decimal doc_id, ends in 0, the words from a = g % n on (g = h div
    10, n words) repeat the first 1 + (n - a) div (3 + g % 8) of them.  Such
    a text's words are joined by one blank."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("hit"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.size("w"))
    # the size of a null array is null or -1
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth of which is made periodic first."""
    found = collapse_runs(with_planted_periods(documents(spark, sf_dir)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
