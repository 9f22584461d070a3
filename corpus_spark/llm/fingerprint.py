"""Threshold-scaled fingerprints of documents.

A fingerprint holds every distinct shingle hash below a fixed fraction of the
hash range, the same for texts of any length, so containment can be estimated
between documents of very unequal length, and fingerprints of parts merge by
union.  A text of n shingles has an empty fingerprint once in 2**n texts, which
tells nothing about it.

Shingles are five consecutive words (maximal runs without the six ASCII white
space characters), A-Z lower-cased; a text with fewer words is one shingle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (LOWER, distinct_per_text, documents, hash_spans, shingle_hashes, shuffle_width, slices,
                     text_buffer, word_spans)

WORDS = 5
#: One in this many hashes is kept.
SCALE = 2


def sketch(buf: np.ndarray, offsets: np.ndarray, scale: int = SCALE,
           words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: sorted distinct kept hashes of each text."""
    starts, ends, first = word_spans(buf, offsets)
    h, at = shingle_hashes(hash_spans(LOWER[buf], starts, ends), first, words)
    keep = h < np.uint64((1 << 64) // scale) if scale > 1 else np.ones(len(h), bool)
    count = np.concatenate(([0], np.cumsum(keep)))
    return distinct_per_text(h[keep], count[at])


def to_string(hashes: np.ndarray) -> str:
    """Sixteen lower-case hex digits for each hash, ascending."""
    return hashes.astype(">u8").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, same_words: bool = False) -> float:
    """Estimated containment of the smaller document in the larger: shared
    hashes by hashes of the smaller fingerprint.  Equal fingerprints with a
    hash have likeness 1.  An empty one has likeness 0 with any other; of two
    empty ones, which say nothing, it is 1 if the caller knows the texts to have
    the ``same_words`` (as two texts without a word have) and 0 otherwise."""
    least = min(len(a), len(b))
    if not least:
        return float(same_words and len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWERED = {c: c + 32 for c in range(65, 91)}


def text_likeness(a: np.ndarray, b: np.ndarray, text: str, other: str) -> float:
    """:func:`likeness` of the fingerprints of two texts at hand."""
    same = not len(a) and not len(b) and (
        _WORD.findall(text.translate(_LOWERED)) == _WORD.findall(other.translate(_LOWERED)))
    return likeness(a, b, same)


def fingerprints(docs: DataFrame, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) -> doc_id and hashes
    (sorted distinct kept hashes as signed longs).  Null texts and texts
    without a word have none; short texts may have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, first = sketch(*text_buffer(part.column(1)), scale, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["doc_id", "hashes"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>")


def merge(fps: DataFrame, *by: str | Column) -> DataFrame:
    """Fingerprints of the groups ``by``: the union of the members' hashes,
    which is the fingerprint of all their shingles.  A group none of whose
    members has a hash has an empty one."""
    hashes = F.sort_array(F.collect_list("hash"))
    return fps.select(*by, F.explode_outer("hashes").alias("hash")).distinct().groupBy(*by).agg(hashes.alias("hashes"))


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of ``a`` (a hashes column) that ``b``
    holds; null where ``a`` has no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


# --- each document beside the next one --------------------------------------------

#: Ranges for each shuffle partition; several small ones even out the tasks.
RANGES = 4


class Ranges:
    """Ranges of rows in the order of descending doc_id (null last), then
    ascending hash, from approximate quantiles of the ids.  An id that fills
    several quantiles, and null ids, are split by their hashes."""

    def __init__(self, quantiles: list[int], nulls: int, rows_each: int):
        self._bounds, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self._parts = np.where(times > 1, times, 0)  # ranges of the bound's own id; 0: with those above it
        width = (self._parts + 1)[::-1]  # from the highest bound down: ids above it, then its own
        self._first = (np.cumsum(width) - width)[::-1]
        self._below = int(width.sum())
        self._nulls = max(1, -(-nulls // max(rows_each, 1)))

    def number(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The range of each row; 0 comes first."""
        filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64

        def slot(parts):
            return np.minimum(np.floor(share * parts).astype(np.int64), np.maximum(parts - 1, 0))
        at = np.searchsorted(self._bounds, filled, side="right") - 1
        out = np.full(len(filled), self._below, np.int64)
        if len(self._bounds):
            i = np.maximum(at, 0)
            own = (self._bounds[i] == filled) & (self._parts[i] > 0)
            out = np.where(at < 0, out, self._first[i] + np.where(own, 1 + slot(self._parts[i]), 0))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return np.where(null, self._below + 1 + slot(np.full(len(filled), self._nulls)), out)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of descending doc_id, each sorted
    within one task: (range, tail, doc_id, text).  Rows with ``tail`` 1 stand
    behind the others of their range and repeat the first document of the
    following one (behind the last range: of the first), so each other row has
    its next document right behind it.

    Texts are shuffled once.  The bounds are approximate quantiles of the ids
    alone; their number follows the number of shuffle partitions, or of input
    splits where these are more.  Rows with the same doc_id stand in the order
    of their texts' hashes and may be spread over ranges; null ids stand last,
    also in several ranges.
    """
    spark = docs.sparkSession
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    width = shuffle_width(docs) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES * width
    found = keys.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    counts = keys.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    ranges = Ranges([int(b) for b in found], counts["n"] - counts["ids"], -(-counts["n"] // n))

    def key(doc_id: int | None, hash_: int) -> tuple:
        return (doc_id is None, -(doc_id or 0), hash_)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for r, i, h in zip(ranges.number(ids, hashes.to_numpy()).tolist(), ids.to_pylist(), hashes.to_pylist()):
                if r not in best or key(i, h) < key(*best[r]):
                    best[r] = (i, h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.keys(), pa.int32()), pa.array([v[0] for v in best.values()], pa.int64()),
             pa.array([v[1] for v in best.values()], pa.int64())], names=["range", "doc_id", "hash"])

    # one row for each range that holds documents
    rows = keys.mapInArrow(firsts, "range int, doc_id long, hash long").groupBy("range").agg(
        F.min_by(F.struct("doc_id", "hash"), F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), "hash"))
        .alias("first")).collect()
    first = {r["range"]: (r["first"]["doc_id"], r["first"]["hash"]) for r in rows}
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first follows the last

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = ranges.number(batch.column(0), batch.column(2).to_numpy())
            head = [i for i, (r, *k) in enumerate(zip(home.tolist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()))
                    if first[r] == tuple(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int32)), pa.array(np.zeros(len(home), np.int32)), *batch.columns],
                names=["range", "tail", *batch.schema.names])
            if head:
                again = batch.take(pa.array(head))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before[int(home[i])] for i in head], pa.int32()), pa.array([1] * len(head), pa.int32()),
                     *again.columns], names=["range", "tail", *batch.schema.names])

    placed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")) \
        .mapInArrow(route, "range int, tail int, doc_id long, text string, hash long")
    return placed.repartition(width, "range") \
        .sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "hash").drop("hash")


def fingerprint_edits(docs: DataFrame, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text; more columns are
    ignored; null: empty) and of its edited text, whose last half (rounded
    down) of code points is replaced by the first as many of the next
    document in descending doc_id order (after the last: the first).  Null ids
    stand last, rows of one id in the order of their texts' hashes; an empty
    table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                rows = carried + list(zip(*(part.column(i).to_pylist() for i in range(4))))
                carried = rows[-1:]
                texts = [r[3] or "" for r in rows]
                own, at = sketch(*text_buffer(pa.array(texts, pa.large_string())), scale, words)
                pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
                edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in pairs]
                other, to = sketch(*text_buffer(pa.array(edited, pa.large_string())), scale, words)
                out = []
                for j, i in enumerate(pairs):
                    mine, next_one, new = own[at[i]:at[i + 1]], own[at[i + 1]:at[i + 2]], other[to[j]:to[j + 1]]
                    out.append((rows[i][2], len(texts[i]), hashlib.sha256(edited[j].encode()).hexdigest(),
                                to_string(mine), to_string(new), text_likeness(mine, new, texts[i], edited[j]),
                                text_likeness(mine, next_one, texts[i], texts[i + 1])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                                    pa.string(), pa.float64(), pa.float64()))],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                               "near_edited", "near_next"])
    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(documents(spark, sf_dir))
