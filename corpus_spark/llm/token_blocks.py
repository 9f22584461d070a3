"""Token ids in patched frame-of-reference blocks.

A *segment* is one byte string with the ids of whole documents on end:

    header   magic "PFR1", block size u32, values u64, blocks u32, documents u32
    doc ids  i64 each (null: the smallest value)
    lengths  u64 each, ids of the document
    starts   u64 each: where in the segment a block begins
    minimum  u32 each block
    width    u8 each block
    patches  u16 each block: number of exceptions
    blocks   the low ``width`` bits of (id - minimum) of ``block size`` ids,
             bit-packed; then the exceptions: positions u16 each, high parts
             u32 each

The width of a block is the number of bits that hold the ``percentile`` of its
differences; larger differences keep their low bits in place and their high
part in the exception list.  A reader finds any block through ``starts``
without decoding the ones before it.

Segments are rows of a Parquet table (Spark commits it task by task, so a lost
executor leaves no half-written file), in ascending doc_id order by
``(shard, segment)``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_width, slices
from .tokenization import ID_TYPE, encode_column

MAGIC = b"PFR1"
HEADER = struct.Struct("<4sIQII")
NULL_ID = -(2**63)
BLOCK_SIZE = 256
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18

#: ``shard_start``: ids of the shard before this segment.
SEGMENTS = ("shard int, segment int, first_id long, n_docs int, shard_start long, n_tokens long, "
            "content binary")


# --- blocks ---------------------------------------------------------------------

def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 32-bit values (0 for 0)."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray,
                 block_size: int = BLOCK_SIZE, percentile: float = PERCENTILE) -> bytes:
    """One segment of the given documents; ``ids``: all their ids on end."""
    if block_size % 8 or not 0 < block_size <= 65536:
        raise ValueError("block_size must be a multiple of 8 up to 65536")
    if not 0 < percentile <= 1:
        raise ValueError("percentile must be in (0, 1]")
    n = len(ids)
    blocks = -(-n // block_size)
    values = np.zeros((blocks, block_size), np.uint32)
    values.reshape(-1)[:n] = ids
    if n % block_size:  # the tail repeats the last id, which costs no bits of its own
        values.reshape(-1)[n:] = ids[-1]
    least = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = values - least[:, None]
    rank = max(0, int(np.ceil(percentile * block_size)) - 1)
    width = _bit_length(np.partition(diff, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    high = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    patches = np.bincount(row, minlength=blocks)
    size = width * (block_size // 8) + 6 * patches
    head = HEADER.size + 16 * len(doc_ids) + 15 * blocks
    starts = head + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if blocks else np.zeros(0, np.int64)
    out = np.zeros(head + int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        wide = 2 if w <= 16 else 4
        raw = diff[which].astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)
        bits = np.unpackbits(raw, axis=1, count=w, bitorder="little")
        packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        out[starts[which][:, None] + np.arange(packed.shape[1])] = packed
    if len(row):
        nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(patches)[:-1]))[row]
        at = (starts + width * (block_size // 8))[row]
        spot = np.ascontiguousarray(col.astype("<u2")).view(np.uint8).reshape(-1, 2)
        out[(at + 2 * nth)[:, None] + np.arange(2)] = spot
        part = np.ascontiguousarray(high[row, col].astype("<u4")).view(np.uint8).reshape(-1, 4)
        out[(at + 2 * patches[row] + 4 * nth)[:, None] + np.arange(4)] = part
    front = HEADER.pack(MAGIC, block_size, n, blocks, len(doc_ids)) + b"".join(
        x.tobytes() for x in (
            np.array([NULL_ID if d is None else d for d in doc_ids], "<i8"), np.array(lengths, "<u8"),
            starts.astype("<u8"), least.astype("<u4"), width.astype(np.uint8), patches.astype("<u2")))
    out[:head] = np.frombuffer(front, np.uint8)
    return out.tobytes()


class Segment:
    """Reader of one segment."""

    def __init__(self, content: bytes):
        magic, self.block_size, self.n_values, blocks, docs = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a segment of token blocks")
        self._bytes = np.frombuffer(content, np.uint8)
        at = HEADER.size
        parts = []
        for kind, n in (("<i8", docs), ("<u8", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks)):
            parts.append(np.frombuffer(content, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc_ids, self.lengths, self.starts, self._least, self._width, self._patches = parts

    def _blocks(self, which: np.ndarray) -> np.ndarray:
        size = self.block_size
        out = np.zeros((len(which), size), np.uint32)
        starts = self.starts[which].astype(np.int64)
        width, patches = self._width[which].astype(np.int64), self._patches[which].astype(np.int64)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            packed = self._bytes[starts[rows][:, None] + np.arange(w * size // 8)]
            bits = np.zeros((len(rows) * size, 16 if w <= 16 else 32), np.uint8)
            bits[:, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w)
            low = np.packbits(bits, axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4")
            out[rows] = low.reshape(len(rows), size)
        total = int(patches.sum())
        if total:
            row = np.repeat(np.arange(len(which)), patches)
            nth = np.arange(total) - np.concatenate(([0], np.cumsum(patches)[:-1]))[row]
            at = (starts + width * (size // 8))[row]
            col = self._bytes[(at + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2").ravel()
            part = self._bytes[(at + 2 * patches[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            shifted = part.astype(np.uint64) << width[row].astype(np.uint64)
            out[row, col] |= shifted.astype(np.uint32)
        return out + self._least[which][:, None]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids ``[start, stop)`` of the segment, decoding only their blocks."""
        stop = self.n_values if stop is None else min(stop, self.n_values)
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block_size, -(-stop // self.block_size)
        found = self._blocks(np.arange(lo, hi)).reshape(-1)
        return found[start - lo * self.block_size:stop - lo * self.block_size]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, start in the segment, ids)`` in the order of the file."""
        values, at = self.ids(), 0
        for doc, length in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            yield (None if doc == NULL_ID else doc), at, values[at:at + length]
            at += length


# --- Spark jobs -----------------------------------------------------------------

def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                       spaces_dropped: bool = False, block_size: int = BLOCK_SIZE,
                       percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text; more columns are ignored) and write their
    segments below ``path`` in ascending doc_id order.

    Null texts are empty, null doc_ids come first, rows with the same doc_id
    stand in the order of their texts' hashes.  An empty text has the end id
    alone.  Texts are shuffled once, by ranges of (doc_id, hash), so rows that
    share a doc_id may be spread over tasks.  A segment ends with the document
    that brings it to ``segment_ids`` ids.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    width = shuffle_width(docs)
    ordered = keyed.repartitionByRange(*[width] * bool(width), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = written = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, size, segment, written
            content = pack_segment([d for d, _ in held], [len(x) for _, x in held],
                                   np.concatenate([x for _, x in held]), block_size, percentile)
            row = pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                 "first_id": pa.array([held[0][0]], pa.int64()), "n_docs": pa.array([len(held)], pa.int32()),
                 "shard_start": pa.array([written], pa.int64()),
                 "n_tokens": pa.array([size], pa.int64()), "content": pa.array([content], pa.binary())})
            held, size, segment, written = [], 0, segment + 1, written + size
            return row

        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column(0).to_pylist(),
                                    encode_column(part.column(1), tokenizer, spaces_dropped, end_id)):
                    held.append((doc, ids))
                    size += len(ids)
                    if size >= segment_ids:
                        yield emit()
        if held:
            yield emit()

    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the segments below ``path``: doc_id, start (ids of all
    documents before it, over all shards), n_tokens, ids_crc32 (unsigned crc32
    of its ids as little-endian unsigned 32-bit integers), shard, segment."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # one row for each shard, that is for each task that wrote
    sizes = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    first, total = {}, 0
    for shard in sorted(sizes):
        first[shard] = total
        total += sizes[shard]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, ahead, content in zip(*(batch.column(i) for i in range(4))):
                base = first[shard.as_py()] + ahead.as_py()
                rows = [(doc, base + at, len(ids), zlib.crc32(ids.astype(ID_TYPE).tobytes()))
                        for doc, at, ids in Segment(content.as_py()).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                    + [pa.array([x.as_py()] * len(rows), pa.int32()) for x in (shard, segment)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"])

    return segments.select("shard", "segment", "shard_start", "content").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, written as patched
    frame-of-reference blocks and read back from them."""
    import public_tokenizers
    from .common import documents
    path = scratch_path(spark, "token-blocks")
    write_token_blocks(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_blocks(spark, path)
