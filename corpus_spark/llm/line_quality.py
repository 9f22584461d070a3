"""Quality rules on the frequency of lines across documents.

Each line is normalised (A-Z lower-cased, white space between words ignored)
and hashed; for each host the documents that hold a line are counted;
lines above the limit are removed from all documents of the host but the first
that holds them; documents that lose most of their words are rejected, as are
documents that fail the base rules on length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (IS_SPACE, LOWER, distinct_per_text, documents, hash_spans, join_small, materialize, mix64,
                     shingle_hashes, slices, text_buffer, unused, word_spans, _power_tables)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line may stand in this many documents of a host, however many it has.
MAX_DOCS = 20
#: A document is depleted when less than this share of its words is left.
LEAST_LEFT = 0.5

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _sequence_hashes(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of word hashes; ``begin``: first word of each run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)))
    end = np.append(begin[1:], len(words))
    return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The lines that hold a word: ``text`` (index), ``words`` (their number),
    ``key`` (hash of the normalised line), ``start`` and ``end`` (bytes)."""
    starts, ends, first = word_spans(buf, offsets)
    breaks = np.flatnonzero(buf == 10)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    above = np.searchsorted(breaks, starts)
    line = above + text
    begin = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    bounds = np.concatenate(([-1], breaks, [len(buf)]))
    keys = _sequence_hashes(hash_spans(LOWER[buf], starts, ends), begin)
    return {"text": text[begin], "words": np.diff(np.append(begin, len(line))), "key": keys,
            "start": np.maximum(bounds[above[begin]] + 1, offsets[text[begin]]),
            "end": np.minimum(bounds[above[begin] + 1], offsets[text[begin] + 1]),
            "word_starts": starts, "word_ends": ends, "first": first}


def text_statistics(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """``(statistics of each text, its lines)``."""
    lines = line_spans(buf, offsets)
    starts, ends, first = lines["word_starts"], lines["word_ends"], lines["first"]
    points = _sums((buf & 0xC0) != 0x80, offsets) - _sums(IS_SPACE[buf], offsets)
    n = len(offsets) - 1
    exact = hash_spans(buf, lines["start"], lines["end"])
    at = np.searchsorted(lines["text"], np.arange(n + 1))
    _, apart = distinct_per_text(exact, at)
    words = hash_spans(buf, starts, ends)
    counts = np.diff(first)
    grams, gram_first = shingle_hashes(words, first, 3)
    text = np.repeat(np.arange(n), np.diff(gram_first))
    long_enough = np.flatnonzero(counts[text] >= 3)
    order = long_enough[np.lexsort((grams[long_enough], text[long_enough]))]
    g, t = grams[order], text[order]
    same = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    window = order[twice]
    word = first[text[window]] + window - gram_first[text[window]]
    covered = np.zeros(len(words) + 1, bool)
    for j in range(3):
        covered[word + j] = True
    return {"n_words": counts, "word_chars": points, "n_symbols": _sums(SYMBOL[buf], offsets),
            "n_dup_lines": np.diff(at) - np.diff(apart),
            "n_repeat_words": _sums(covered[:-1], first)}, lines


def line_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, host and content hashes, the base
    statistics, and its distinct normalised lines (hash, words in the text)."""
    keyed = docs.select("doc_id", "text", F.xxhash64(host, F.col(host).isNull()).alias("host"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, offsets = text_buffer(part.column(1))
                stats, lines = text_statistics(buf, offsets)
                order = np.lexsort((lines["key"], lines["text"]))
                key, text, words = (lines[x][order] for x in ("key", "text", "words"))
                new = np.flatnonzero((np.diff(key, prepend=0) != 0) | (np.diff(text, prepend=-1) != 0))
                per_line = np.add.reduceat(words, new) if len(new) else np.zeros(0, np.int64)
                to = pa.array(np.searchsorted(text[new], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3),
                     *(pa.array(stats[c].astype(np.int64)) for c in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     pa.ListArray.from_arrays(to, pa.array(key[new].view(np.int64))),
                     pa.ListArray.from_arrays(to, pa.array(per_line.astype(np.int64)))],
                    names=["doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                           "n_repeat_words", "line_keys", "line_words"])

    return keyed.mapInArrow(run, "doc_id long, host long, content long, " + _STATISTICS
                            + ", line_keys array<long>, line_words array<long>")


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS,
                  least_left: float = LEAST_LEFT, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ``host``; more columns are
    ignored): doc_id, the base statistics, base_failed, kept, removed_words,
    removed (hashes of the lines to remove), and the hashes host and content
    that with doc_id name the row.

    A line is above the limit when more than ``max_docs`` documents of its host
    hold it; every row is a document, copies and rows that repeat each other
    included, and the limit is the same for hosts of any size.  Of the documents
    with such a line the first by (doc_id, content) keeps it, so that no line is
    lost from the corpus (rows that repeat that one keep it, too).  A null host
    is a host of its own; null and empty texts have no words and fail the base
    rules; null doc_ids come first; an empty table has no verdicts.  Only hashes
    and counts are shuffled, never texts; a line that a third of all documents
    hold is counted before the shuffle.
    """
    stats = materialize(line_statistics(docs, host), "line-statistics")
    lines = stats.select("doc_id", "host", "content",
                         F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")) \
        .select("doc_id", "host", "content", F.col("l.line_keys").alias("line"), F.col("l.line_words").alias("words"))
    # a document has each of its lines once
    above = materialize(
        lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "content")).alias("first"))
        .where(F.col("n") > max_docs)
        .select("host", "line", F.col("first.doc_id").alias("first_id"), F.col("first.content").alias("first_content")),
        "frequent-lines")
    gone = join_small(lines, above, ["host", "line"]) \
        .where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content")))) \
        .groupBy("doc_id", "host", "content", "line").agg(F.max("words").alias("words")) \
        .groupBy("doc_id", "host", "content") \
        .agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))
    base = stats.drop("line_keys", "line_words").alias("b")
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return base.join(
        gone.alias("g"), F.col("b.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("b.host") == F.col("g.host"))
        & (F.col("b.content") == F.col("g.content")), "left") \
        .select("b.*", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
                F.coalesce("removed", F.array().cast("array<long>")).alias("removed")) \
        .withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & (left >= least_left * F.col("n_words")))


def remove_lines(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, all columns (whatever their names), without
    the lines that ``verdicts`` (of :func:`quality_rules` over the same rows)
    removes; n_chars, if there, becomes the new length.  Rows that repeat each
    other are all kept or all rejected."""
    own_host, content, i, h, c, removed = (unused(x, docs) for x in ("_host", "_content", "_id", "_h", "_c", "_removed"))
    keyed = docs.withColumn(own_host, F.xxhash64(host, F.col(host).isNull())) \
        .withColumn(content, F.xxhash64(F.coalesce("text", F.lit(""))))
    keep = verdicts.where("kept").select(F.col("doc_id").alias(i), F.col("host").alias(h),
                                         F.col("content").alias(c), F.col("removed").alias(removed)) \
        .dropDuplicates([i, h, c])
    found = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep[i]) & (keyed[own_host] == keep[h])
                       & (keyed[content] == keep[c])).select(*docs.columns, removed)
    text, gone, size = (found.columns.index(x) if x in found.columns else -1 for x in ("text", removed, "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(text).to_pylist()
                for i, remove in enumerate(part.column(gone).to_pylist()):
                    if remove:
                        raw = texts[i].encode()
                        buf = np.frombuffer(raw, np.uint8)
                        lines = line_spans(buf, np.array([0, len(buf)]))
                        out = np.isin(lines["key"].view(np.int64), np.array(remove, np.int64))
                        mask = np.ones(len(buf), bool)
                        for s, e in zip(lines["start"][out].tolist(), lines["end"][out].tolist()):
                            mask[s:e + 1] = False  # with the line feed behind it
                        texts[i] = buf[mask].tobytes().decode()
                columns = [part.column(i) for i in range(part.num_columns) if i != gone]
                columns[text] = pa.array(texts, pa.string())
                if size >= 0:
                    columns[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in part.schema.names if n != removed])

    return found.mapInArrow(run, docs.schema)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict on every document; hosts are sources."""
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words", F.size("removed").cast("long").alias("removed_lines"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS k FROM documents),
g AS (SELECT doc_id, i, k[i] || ' ' || k[i + 1] || ' ' || k[i + 2] AS gram
      FROM (SELECT doc_id, k, unnest(range(1, len(k) - 1)) AS i FROM d)),
o AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM o, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT doc_id, source, t, l, regexp_extract_all(l, '{_WORD}') AS w FROM raw WHERE regexp_matches(l, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY doc_id),
n AS (SELECT doc_id, source, t, array_to_string(list_transform(w, lambda x: translate(x, '{_UPPER}', '{_LOWERED}')), ' ') AS line,
             sum(len(w)) AS words FROM l GROUP BY ALL),
f AS (SELECT source, line, min(doc_id) AS keeper FROM n GROUP BY source, line HAVING count(*) > {MAX_DOCS}),
gone AS (SELECT doc_id, sum(words) AS words, count(*) AS lines FROM n JOIN f USING (source, line) WHERE doc_id <> keeper GROUP BY doc_id),
b AS (SELECT doc_id, len(k)::BIGINT AS n_words, coalesce(list_sum(list_transform(k, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.words, 0)::BIGINT AS removed_words,
             coalesce(gone.lines, 0)::BIGINT AS removed_lines
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= {LEAST_LEFT} * n_words AS kept, removed_words, removed_lines FROM v
"""
