"""Exact Jaccard similarity of all pairs of documents that share an LSH bucket.

The pairs of a bucket are as many as its result rows, so their number grows
with the square of a bucket; what goes through a shuffle does not.  A bucket's
documents are dealt into blocks, and a pair of blocks, with the sets of both,
is one piece of work of bounded size: its shared shingles are counted by matrix
products, and only ids and similarities leave it.

A pair that shares several buckets is listed in the smallest of them.
Documents of a bucket that have the same smaller buckets were listed there, so
of the largest such group no two documents are brought together again.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of a block, and characters of their texts (which are at least as many as their shingles).
BLOCK_ROWS = 500
BLOCK_CHARS = 1 << 22
#: Distinct values that are columns of one matrix product.
_COLUMNS = 2048


def bucket_places(members: DataFrame) -> DataFrame:
    """``(id, buckets, places)`` of ``members`` (id, buckets, chars; a row for
    each document): ``places`` has, for each bucket in which the document is
    brought together with others, the bucket, whether the document is of its
    ``rest`` (all but the largest group that was listed before), and the
    number of blocks of the rest and of that group."""
    seen = F.filter("buckets", lambda b: b < F.col("bucket"))
    rows = members.select("id", "chars", F.explode("buckets").alias("bucket"), "buckets") \
        .select("id", "chars", "bucket", F.when(F.size(seen) > 0, F.xxhash64(seen)).alias("group"))
    per = rows.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, chars: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(chars / BLOCK_CHARS), (n > 0).cast("long"))
    main = F.max(F.when(F.col("group").isNotNull(), F.struct("n", "group", "chars")))
    sizes = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), main.alias("main")).filter("n > 1")
    n_main, chars_main = F.coalesce("main.n", F.lit(0)), F.coalesce("main.chars", F.lit(0))
    sizes = sizes.select("bucket", F.col("main.group").alias("main"), blocks(F.col("n") - n_main, F.col("chars") - chars_main)
                         .alias("n_rest"), blocks(n_main, chars_main).alias("n_main")).filter("n_rest > 0")
    rest = F.col("group").isNull() | F.col("main").isNull() | (F.col("group") != F.col("main"))
    places = rows.select("id", "bucket", "group").distinct().join(sizes, "bucket").groupBy("id").agg(
        F.collect_list(F.struct("bucket", rest.alias("rest"), "n_rest", "n_main")).alias("places"))
    return members.select("id", "buckets").distinct().join(places, "id")


def bucket_blocks(sets: DataFrame) -> DataFrame:
    """``(bucket, i, j, first, id, buckets, hashes)``: ``sets`` (id, buckets,
    places, hashes) once for each pair of blocks ``i <= j`` of each of its
    buckets that it is in, ``first`` where it is of block ``i``."""
    placed = sets.select("id", "buckets", "hashes", F.xxhash64("id", "hashes").alias("h"), F.explode("places").alias("p"))
    deal = lambda n: F.pmod("h", n)
    rest, n_rest, n_main = F.col("p.rest"), F.col("p.n_rest"), F.col("p.n_main")
    own = F.when(rest, deal(n_rest)).otherwise(n_rest + deal(n_main))
    # a block of the rest meets every block, once; one of the main group meets those of the rest
    others = F.sequence(F.lit(0).cast("long"), F.when(rest, n_rest + n_main).otherwise(n_rest) - 1)
    return placed.withColumn("own", own).withColumn("other", F.explode(others)).select(
        F.col("p.bucket").alias("bucket"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("first"), "id", "buckets", "hashes")


def shared_counts(values: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many values the distinct values ``values[r]`` and ``values[c]``
    have in common, for each of ``rows`` and ``cols``."""
    sizes = np.array([len(v) for v in values])
    _, column = np.unique(np.concatenate(values), return_inverse=True)
    owner = np.repeat(np.arange(len(values)), sizes)
    keep = np.bincount(column)[column] > 1  # what one row alone has is shared with none
    owner = owner[keep]
    _, column = np.unique(column[keep], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    spots = []
    for side in (rows, cols):
        spots.append(np.full(len(values), -1))
        spots[-1][side] = np.arange(len(side))
    out = np.zeros((len(rows), len(cols)))
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        some = []
        for side, spot in zip((rows, cols), spots):
            r = spot[owner[a:b]]
            m = np.zeros((len(side), min(_COLUMNS, width - at)), np.float32)
            m[r[r >= 0], column[a:b][r >= 0] - at] = 1
            some.append(m)
        out += some[0] @ some[1].T
    return out


def block_pairs(bucket: int, alone: bool, first: np.ndarray, ids: np.ndarray, buckets: list[np.ndarray],
                hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, candidate, jaccard)`` of the pairs of a first and a second block
    (``alone``: of one block) whose smallest common bucket is ``bucket``."""
    rows, cols = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
    less, more = ids[rows][:, None] < ids[cols][None, :], ids[rows][:, None] > ids[cols][None, :]
    wanted = less if alone else less | more
    if wanted.any():
        wanted = wanted & (shared_counts([b[b < bucket] for b in buckets], rows, cols) == 0)
    at, to = np.nonzero(wanted)
    if not len(at):
        return ids[:0], ids[:0], np.zeros(0)
    shared = shared_counts(hashes, rows, cols)[at, to]
    sizes = np.array([len(h) for h in hashes])
    union = sizes[rows][at] + sizes[cols][to] - shared
    jaccard = np.divide(shared, union, out=np.ones(len(at)), where=union > 0)
    x, y, ordered = ids[rows][at], ids[cols][to], less[at, to]
    return np.where(ordered, x, y), np.where(ordered, y, x), jaccard


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of numbers, each an array of its own."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b].copy() for a, b in zip(at[:-1], at[1:])]


def pair_similarities(sets: DataFrame) -> DataFrame:
    """``(id, candidate, jaccard)``, ``id < candidate``, of all rows of ``sets``
    (id, buckets, places, hashes ARRAY<BIGINT> without repeats) that share a
    bucket, each pair once; two empty sets have similarity 1."""
    key = ("bucket", "i", "j")
    ordered = bucket_blocks(sets).repartition(*key).sortWithinPartitions(*key)
    kind = sets.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = id_type = None

        def found() -> pa.RecordBatch:
            first, ids, buckets, hashes = zip(*held)
            ids = pa.array(ids, id_type).to_numpy(zero_copy_only=False)
            a, b, jaccard = block_pairs(now[0], now[1] == now[2], np.array(first), ids, buckets, hashes)
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type), pa.array(jaccard)],
                                              names=["id", "candidate", "jaccard"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            plain = [batch.column(k).to_pylist() for k in range(5)]
            for *at, first, doc, buckets, hashes in zip(*plain, _lists(batch.column(5)), _lists(batch.column(6))):
                if at != now:
                    if held:
                        yield found()
                    held, now = [], at
                held.append((first, doc, buckets, hashes))
        if held:
            yield found()

    return ordered.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("candidate", kind),
                                                 T.StructField("jaccard", T.DoubleType())]))
