"""Helpers shared by the operators of this subpackage: scratch tables in the
shared checkpoint folder, Arrow text buffers, and vectorised word hashing.

Every helper takes whole texts.  Batches are cut into slices of bounded bytes
(a single longer text is a slice of its own), so the arrays a task holds do
not grow with the number of rows in an Arrow batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20


# --- tables ------------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, or a name after it that no column of ``tables`` has (in any
    case of letters)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(df: DataFrame) -> int | None:
    """A number of shuffle partitions that follows the input: that of the
    splits it is read in, where these are more than
    ``spark.sql.shuffle.partitions``; otherwise None, which leaves it to Spark."""
    splits = df.rdd.getNumPartitions()
    return splits if splits > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def lowest_values(values: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest distinct values of the one column of ``values``,
    64-bit hashes of rows.  They are looked for below the value that twice as
    many distinct ones are expected to be below, so the task that orders them
    gets a bounded number of rows, however often rows are repeated."""
    (h,) = values.columns
    apart = values.agg(F.approx_count_distinct(h)).first()[0]
    if apart > 4 * limit:
        values = values.where(F.col(h) < int(-(2**63) + 2**64 * (2 * limit / apart)))
    return values.distinct().orderBy(h).limit(limit)


def lowest_hashes(keys: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """The ``limit`` rows of ``keys`` (doc_id and other short columns) with the
    lowest hashes of doc_id.  They are looked for below the hash that twice as
    many rows are expected to be below, so the task that orders them gets a
    bounded number of rows.  ``rows``: the number of rows, if known."""
    rows = keys.count() if rows is None else rows
    h = F.xxhash64("doc_id")
    if rows > 2 * limit:
        keys = keys.where(h < int(-(2**63) + 2**64 * (2 * limit / rows)))
    return keys.orderBy(h, "doc_id").limit(limit)


# --- Arrow texts ---------------------------------------------------------------

def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array: the UTF-8 bytes of all its
    texts on end, and ``len + 1`` offsets from 0.  Nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices whose texts have at most
    ``limit`` bytes together (or that hold one longer text)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        before, at = int(ends[to - 1]), to


# --- words and their hashes -------------------------------------------------------

#: Words are maximal runs without these six bytes (0x20, 0x09-0x0D).
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240601)
_BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**64, dtype=np.uint64)) | 5  # odd: has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 2**64)
_MULTIPLIERS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               piece: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[starts, ends)`` of ``buf`` (sorted,
    not overlapping, not empty).  Worked off in pieces of about ``piece``
    bytes, cut between ranges."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[buf[lo:hi]] * up[:hi - lo], out=total[1:], dtype=np.uint64)
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges ``[start, start + length)`` of ``pool`` on end."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte ranges of all words of all texts, and
    for each text the index of its first word (``len(texts) + 1`` entries)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[buf]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)`` of the windows of ``k`` words of each text; a text
    with fewer words, but at least one, has its whole word sequence as one
    shingle.  ``words``: hashes of all words on end, ``first``: each text's
    first word."""
    counts = np.diff(first)
    n_out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(n_out))).astype(np.int64)
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    text = np.repeat(np.arange(len(counts)), n_out)
    begin = first[:-1][text] + (np.arange(total) - out_first[:-1][text])
    length = np.minimum(counts[text], k).astype(np.int64)
    acc = np.zeros(total, np.uint64)
    for j in range(k):
        at = np.minimum(begin + j, len(words) - 1)
        acc += np.where(j < length, words[at] * _MULTIPLIERS[j], np.uint64(0))
    return mix64(acc + length.astype(np.uint64) * _MULTIPLIERS[63]), out_first


def distinct_per_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text."""
    if not len(hashes):
        return hashes, np.zeros(len(first), np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[keep], t[keep]
    return h, np.searchsorted(t, np.arange(len(first)), side="left")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Join a materialised table of short rows to a large one whose keys may be
    hot.  Up to ``max_rows`` rows (counted) it is broadcast; beyond, the large
    side's keys are salted and the small side is repeated for each salt, so no
    key stays in one task.  ``how``: inner or left."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salt = unused("_salt", big, small)
    # of the row's own values, so that a task that runs again salts alike
    spread = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    every = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(every, [*on, salt], how).drop(salt)


class HashIndex:
    """Numbers distinct 64-bit keys 0, 1, 2, ... in the order in which they are
    added; open addressing, all operations on arrays."""

    def __init__(self, size: int = 1 << 12):
        self.n = 0
        self._mask = size - 1
        self._key, self._number = np.zeros(size, np.uint64), np.full(size, -1, np.int64)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = (keys & np.uint64(self._mask)).astype(np.int64), np.arange(len(keys))
        while len(left):  # of the keys that want a free slot one gets it, the others step on
            free = left[self._number[slot[left]] < 0]
            self._key[slot[free]] = keys[free]
            self._number[slot[free]] = numbers[free]
            left = left[self._key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self._mask

    def add(self, keys: np.ndarray) -> None:
        """New distinct keys."""
        if 2 * (self.n + len(keys)) > self._mask + 1:
            full = self._number >= 0
            old = self._key[full], self._number[full]
            while 2 * (self.n + len(keys)) > self._mask + 1:
                self._mask = 2 * self._mask + 1
            self._key, self._number = np.zeros(self._mask + 1, np.uint64), np.full(self._mask + 1, -1, np.int64)
            self._place(*old)
        self._place(keys, self.n + np.arange(len(keys)))
        self.n += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 where absent."""
        slot = (keys & np.uint64(self._mask)).astype(np.int64)
        found = self._number[slot]
        out = np.where(self._key[slot] == keys, found, -1)
        todo = np.flatnonzero((out < 0) & (found >= 0))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self._mask
            found = self._number[at]
            hit = (self._key[at] == keys[todo]) & (found >= 0)
            out[todo[hit]] = found[hit]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return out
