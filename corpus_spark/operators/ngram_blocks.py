"""Trigram counts and look-ups in blocks of 64-bit keys.

Tokens never become rows.  A scan cuts texts into tokens, hashes them, and deals
the trigrams of many documents to shards; what a task has for a shard is one row
with arrays on end.  A shard gets the counts of the training table and the
trigrams that are asked for, adds up the logarithms of what it knows by
document, and deals the rest on to a shorter context:

  tri   (u, v, w)  in shards of (u, v):  log c(uvw) - log c(uv)
  bi    (v, w)     in shards of v:       log c(vw) - log c(v) + one step back
  word  w          in shards of w:       log p1(w) + two steps back

Trigrams are worked off in rounds, a slice of all middle tokens ``v`` at a time,
each of which reads the texts again, and the shuffle files of a round are gone
before the next one begins: what is on disk at a time is a part of the whole.
Equal hashes of different keys (once in 2**64 pairs) would count as one.
"""

from __future__ import annotations

import uuid
from itertools import groupby
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN
from ..llm.common import hash_spans, mix64, slices, text_buffer
from ..session import ensure_checkpoint_dir

#: Rounds at most, and characters from which there is one more.
ROUNDS = 4
ROUND_CHARS = 64 << 20
#: Bytes of texts worked off at a time: few enough to stay in a core's cache.
SLICE = 1 << 18
#: Characters of a shard's part of the texts, and tokens that a task holds before it deals them out.
SHARD_CHARS = 12 << 20
HELD = 3 << 18

_START = np.uint64(0x3C733E3C733E3C73)  # the token before the first
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
TRAIN, ASKED, SUMS = 0, 1, 2
#: Documents and the number of items of each, and of items: the hash of their context, (``TRAIN``) of themselves, their
#: last two tokens.  In ``TRAIN`` blocks ``n`` is how often an item is there, once if it is null.
_COLUMNS = ("ids", "n", "sums", "context", "item", "v", "w")
BLOCK = ", ".join(["shard int", "kind int"] + [f"{x} binary" for x in _COLUMNS])
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32())] + [(x, pa.binary()) for x in _COLUMNS])


# --- tokens -----------------------------------------------------------------------
_classes: dict[str, np.ndarray] = {}


def token_classes(spark: SparkSession) -> np.ndarray:
    """For each code point 1 where it is a word character of
    ``TOKEN_PATTERN``, 2 where it is a token of its own, else 0."""
    if TOKEN_PATTERN not in _classes:
        # behind a letter, as U+FEFF is left out where a text begins
        char = F.substring(F.decode(F.unhex(F.concat(F.lit("00000041"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32"), 2, 1)
        kind = F.when(char.rlike(r"(?U)\w"), 1).when(char.rlike(r"(?U)[^\w\s]"), 2).otherwise(0)
        # code points that no text has, as they are halves of others
        rows = spark.range(0x110000).filter("id < 55296 OR id > 57343").select("id", kind.cast("int").alias("k")).toArrow()
        table = np.full(0x110000, 2, np.uint8)
        table[rows.column("id").to_numpy()] = rows.column("k").to_numpy()
        _classes[TOKEN_PATTERN] = table
    return _classes[TOKEN_PATTERN]


def token_spans(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte ranges of all tokens of all texts, and
    for each text the index of its first token (``len(texts) + 1`` entries)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = [np.concatenate((buf, np.zeros(3, np.uint8)))[lead + i].astype(np.int64) for i in range(4)]
        low = [x & 0x3F for x in b]
        width = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        point = np.select([width == 2, width == 3], [(b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]],
                          (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3])
        own = classes[np.minimum(point, 0x10FFFF)]
        kind[lead] = own
        for i in range(1, 4):  # the other bytes of a character: 3 in a token of its own
            more = (width > i) & (lead + i < n)
            kind[lead[more] + i] = np.where(own[more] == 2, 3, own[more])
    word = kind == 1
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    stop[:-1] &= ~word[1:] | cut[1:n]
    begin |= kind == 2
    single = kind >= 2
    single[:-1] &= kind[1:] != 3
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop | single) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def _contexts(batch: pa.RecordBatch, classes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(id, u, v, w)`` of all tokens of a batch (id, text), a slice at a time."""
    for part in slices(batch, limit=SLICE):
        buf, offsets = text_buffer(part.column(1))
        starts, ends, first = token_spans(buf, offsets, classes)
        w = hash_spans(buf, starts, ends)
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        begin = first[:-1][np.diff(first) > 0]
        v[begin] = u[begin] = _START
        second = first[:-1][np.diff(first) > 1] + 1
        u[second] = _START
        yield np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(first)), u, v, w


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(u * _M[0] + v * _M[1] + _M[3])


def _then(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(context * _M[2] + w * _M[0])


# --- blocks -----------------------------------------------------------------------

def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between each two cuts as one binary value."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _block(shards: np.ndarray, kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(shards)
    return pa.RecordBatch.from_arrays(
        [pa.array(shards.astype(np.int32)), pa.array(np.full(n, kind, np.int32))]
        + [columns[x] if x in columns else pa.nulls(n, pa.binary()) for x in _COLUMNS], schema=_ARROW)


def _dealt(shard: np.ndarray, kind: int, ids: np.ndarray | None = None, **items: np.ndarray) -> pa.RecordBatch:
    """A block for each shard of ``items``; with ``ids``, the documents of the
    items, by document."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    new = np.concatenate(([True], shard[1:] != shard[:-1]))
    cuts = np.append(np.flatnonzero(new), len(shard))
    columns = {k: _binary(x[order], cuts) for k, x in items.items()}
    if ids is not None:
        ids = ids[order]
        new[1:] |= ids[1:] != ids[:-1]
        begin = np.flatnonzero(new)
        documents = np.searchsorted(begin, cuts)
        columns["ids"] = _binary(ids[begin], documents)
        columns["n"] = _binary(np.diff(np.append(begin, len(shard))).astype(np.int32), documents)
    return _block(shard[cuts[:-1]], kind, **columns)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each is there."""
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))
    return ordered[begin], np.diff(np.append(begin, len(ordered)))


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[begin], np.add.reduceat(n, begin) if len(key) else n


class Table:
    """Look-ups of sorted distinct hashes: by their first bits, then one after the other."""

    def __init__(self, key: np.ndarray):
        bits = max(len(key).bit_length(), 1)
        self.key, self.shift = np.append(key, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.start = np.concatenate(([0], np.cumsum(np.bincount((key >> self.shift).astype(np.int64), minlength=1 << bits))))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Where each is, -1 if it is not there."""
        at = self.start[(asked >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.key[at] < asked)
        while len(todo):
            at[todo] += 1
            todo = todo[self.key[at[todo]] < asked[todo]]
        return np.where((self.key[at] == asked) & (at < len(self.key) - 1), at, -1)


def _array(value: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(value or b"", kind)


def _shard(context: np.ndarray, rounds: int, shards: int) -> np.ndarray:
    return (context // np.uint64(rounds) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)


def scan(texts: DataFrame, classes, level: str, kind: int, shards: int, rounds: int = 1, turn: int = 0) -> DataFrame:
    """Blocks of what ``texts`` (number BIGINT, text) has for a level in a
    round: all items by document (``ASKED``; of trigrams), or without (``TRAIN``)."""
    def deal(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        items = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        if level == "word":
            items["item"], n = _runs(np.sort(items["item"]))
            items |= {"n": n, "shard": _shard(items["item"], 1, shards)}
        return _dealt(items.pop("shard"), kind, **items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            for some in _contexts(batch, classes.value):
                if rounds > 1:
                    mine = some[2] % np.uint64(rounds) == turn
                    some = [x[mine] for x in some]
                ids, u, v, w = some
                if not len(w):
                    continue
                context = _pair(u, v) if level == "tri" else v
                if level == "word":
                    held.append({"item": w})
                elif kind == TRAIN:
                    held.append({"shard": _shard(context, rounds, shards), "context": context, "item": _then(context, w)})
                else:
                    held.append({"shard": _shard(context, rounds, shards), "ids": ids, "context": context, "v": v, "w": w})
                size += len(w)
                if size >= HELD:
                    yield deal(held)
                    held, size = [], 0
        if size:
            yield deal(held)

    return texts.mapInArrow(run, BLOCK)


def _by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """The rows of sorted batches, shard by shard."""
    rows = ({k: batch.column(k)[i].as_py() for k in _ARROW.names} for batch in batches for i in range(batch.num_rows))
    return groupby(rows, key=lambda r: r["shard"])


def _words(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of training blocks and their numbers."""
    return _added(*(np.concatenate([_array(b[k], kind) for b in blocks]) for k, kind in (("item", np.uint64), ("n", np.int64))))


def count_words(texts: DataFrame, classes, shards: int) -> DataFrame:
    """Training blocks of all tokens, one for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _shards(batches):
            item, n = _words(list(blocks))
            all_ = np.array([0, len(item)])
            yield _block(np.array([shard]), TRAIN, item=_binary(item, all_), n=_binary(n, all_))

    return _by_shard(scan(texts, classes, "word", TRAIN, shards), shards).mapInArrow(run, BLOCK)


def _model(blocks: list[dict], level: str, step: float, words: tuple[int, float]):
    """A function from (context, v, w) to whether items are known and their
    log-probabilities, with ``step`` added.  ``words``: what is added to a
    token's number, and the logarithm of what it is divided by."""
    if level == "word":
        item, n = _words(blocks) if blocks else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        table = Table(item)
        # the last one is for tokens that were never seen
        known = np.log(np.append(n, 0) + words[0]) - words[1] + step
        return lambda context, v, w: (np.ones(len(w), bool), known[table.find(w)])
    item, n = _runs(np.sort(np.concatenate([_array(b["item"], np.uint64) for b in blocks] or [np.zeros(0, np.uint64)])))
    context, total = _runs(np.sort(np.concatenate([_array(b["context"], np.uint64) for b in blocks] or [np.zeros(0, np.uint64)])))
    items, contexts = Table(item), Table(context)
    log_n, log_total = np.append(np.log(n), 0.0), np.append(np.log(total), 0.0)

    def of(context, v, w):
        context = v if level == "bi" else context
        at = items.find(_then(context, w))
        return at >= 0, log_n[at] - log_total[contexts.find(context)] + step

    return of


def look_up(blocks: DataFrame, level: str, shards: int, rounds: int, shards_next: int, step: float,
            words: tuple[int, float]) -> DataFrame:
    """From training blocks and asked ones of a level: ``SUMS`` blocks of the
    log-probabilities of the items that are known, by document, and ``ASKED``
    blocks of the next level for the others; see :func:`_model`."""
    def passed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, v, w = (np.concatenate(x) for x in zip(*held))
        if level == "tri":
            return _dealt(_shard(v, rounds, shards_next), ASKED, ids, v=v, w=w)
        return _dealt(_shard(w, 1, shards_next), ASKED, ids, w=w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            training, model = [], None
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for b in rows:
                if b["kind"] == TRAIN:
                    training.append(b)
                    continue
                if model is None:
                    model = _model(training, level, step, words)
                    training.clear()
                ids, n = _array(b["ids"], np.int64), _array(b["n"], np.int32)
                context, v, w = (_array(b[k], np.uint64) for k in ("context", "v", "w"))
                hit, lp = model(context, v, w)
                begin = np.cumsum(n) - n
                count = np.add.reduceat(hit.astype(np.int64), begin)
                some = count > 0
                if some.any():
                    cuts = np.array([0, some.sum()])
                    sums = np.add.reduceat(np.where(hit, lp, 0.0), begin)
                    yield _block(np.zeros(1), SUMS, ids=_binary(ids[some], cuts), n=_binary(count[some], cuts),
                                 sums=_binary(sums[some], cuts))
                if not hit.all():
                    held.append((np.repeat(ids, n)[~hit], v[~hit], w[~hit]) if level == "tri"
                                else (np.repeat(ids, n)[~hit], w[~hit], w[~hit]))
                    size += len(held[-1][0])
                if size >= HELD:
                    yield passed(held)
                    held, size = [], 0
            if size:
                yield passed(held)

    return _by_shard(blocks, shards).mapInArrow(run, BLOCK)


def document_sums(blocks: DataFrame) -> DataFrame:
    """``(number, lp, n)``: sums of ``SUMS`` blocks by document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, sums in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(_array(ids, np.int64)), pa.array(_array(sums, np.float64)),
                                                  pa.array(_array(n, np.int64))], names=["number", "lp", "n"])

    rows = blocks.filter(F.col("kind") == SUMS).select("ids", "n", "sums").mapInArrow(run, "number long, lp double, n long")
    return rows.groupBy("number").agg(F.sum("lp").alias("lp"), F.sum("n").alias("n"))


# --- scratch tables ---------------------------------------------------------------
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written below the checkpoint folder, whose writing leaves no
    shuffle files; :meth:`drop` removes those that are not needed any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
