"""Shortest-pack-first packing of tokenised documents over the histogram of
their lengths.

Documents are cut into pieces of at most one sequence.  The lengths of all
pieces form a histogram of at most ``size`` bins, whatever the number of
documents; lengths are placed longest first, each into the shortest open pack
it fits (or a new one), whole counts at a time, so that what comes out is a
short list of patterns with counts.  The patterns are joined back to the
pieces by rank: the r-th piece of a length takes the r-th place that the
patterns have for that length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .tokenization import ID_TYPE, encode_column

SEQUENCE = 4096

PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth long"


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """``[(count, lengths of one pack), ...]``: patterns that hold every piece
    of the histogram ``length -> count`` once.

    Lengths are placed longest first.  Packs are kept by what is left in them;
    a length goes to the packs with the most room, as many at a time as there
    are, and to new packs when it fits none.  Each length splits at most one
    group of packs, so there are at most two patterns for each length.
    """
    if any(not 0 < n <= size for n in counts):
        raise ValueError(f"lengths must be between 1 and {size}")
    open_packs: dict[int, list[tuple[int, tuple]]] = {}  # room -> groups of equal packs
    rooms: list[int] = []  # heap of the negative rooms in use

    def put(room: int, count: int, pack: tuple) -> None:
        if room not in open_packs:
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append((count, pack))

    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left = counts[length]
        while left:
            if not rooms or -rooms[0] < length:
                put(size - length, left, (length, None))
                break
            room = -rooms[0]
            count, pack = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                heapq.heappop(rooms)
            taken = min(left, count)
            if count > taken:
                put(room, count - taken, pack)
            put(room - length, taken, (length, pack))
            left -= taken
    out = []
    for room in sorted(open_packs):
        for count, pack in open_packs[room]:
            lengths = []
            while pack:  # packs share their tails
                lengths.append(pack[0])
                pack = pack[1]
            out.append((count, tuple(reversed(lengths))))
    return out


class Places:
    """Where the r-th piece of a length goes.  Runs of equal lengths in a
    pattern are one entry; a pattern has at most sqrt(2 * size) of them, so
    the arrays are bounded by the size of a sequence alone."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for count, lengths in patterns:
            at = i = 0
            while i < len(lengths):
                times = 1
                while i + times < len(lengths) and lengths[i + times] == lengths[i]:
                    times += 1
                entries.setdefault(lengths[i], []).append((count * times, sequence, times, at))
                at += times * lengths[i]
                i += times
            sequence += count
        self.n_sequences = sequence
        # by length: first rank, first sequence, pieces of the length in a sequence, offset
        self._of = {n: tuple(np.array(c, np.int64) for c in zip(*(
            (first, s, t, a) for first, (_, s, t, a) in
            zip(np.concatenate(([0], np.cumsum([e[0] for e in found])[:-1])).tolist(), found))))
            for n, found in entries.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, offset)`` of pieces given by length and rank."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            first, start, times, at = self._of[n]
            entry = np.searchsorted(first, ranks[which], side="right") - 1
            nth = ranks[which] - first[entry]
            sequence[which] = start[entry] + nth // times[entry]
            offset[which] = at[entry] + nth % times[entry] * n
        return sequence, offset


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, spaces_dropped: bool, size: int) -> DataFrame:
    """The documents' pieces with their ids (little-endian unsigned 32-bit
    integers), written out.  ``part`` is the task that cut a piece and ``nth``
    counts the task's pieces of the same length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(),
                                    encode_column(part.column(1), tokenizer, spaces_dropped, end_id)):
                    for at in range(0, len(ids), size):
                        piece = ids[at:at + size]
                        n = len(piece)
                        rows.append((doc, at, n, len(ids), piece.astype(ID_TYPE).tobytes(), part_id, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                                                                 pa.binary(), pa.int32(), pa.int64()))],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")


def place_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` (length, part, nth and any other columns; a table that can be
    read again) with sequence_id and offset.

    The rank of a piece among those of its length is nth plus the number of
    such pieces in the parts before its own, so a length that very many
    documents share is ranked by all tasks together.  The driver gets the
    histogram of lengths, which has at most ``size`` rows.
    """
    per_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack_histogram(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("_rank", F.col("nth") + F.col("_ahead"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                            for c in ("length", "_rank"))
            sequence, offset = places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return ranked.select(*kept, "_rank").mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, spaces_dropped: bool = True,
                   size: int = SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs`` (doc_id, text; more columns are ignored) and pack the
    pieces: ``(pieces, placed)``, where ``pieces`` holds the ids and ``placed``
    has doc_id, start, length, doc_tokens, ids_crc32, piece (names a row of
    ``pieces`` as part:length:nth), sequence_id and offset.

    Null and empty texts are the end id alone.  Rows that share a doc_id are
    packed as documents of their own.  Ids are written once and not shuffled.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, spaces_dropped, size)
    keyed = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"),
                          piece_name().alias("piece"), "part", "nth")
    return pieces, place_pieces(keyed, size)


def piece_name():
    return F.concat_ws(":", "part", "length", "nth")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (array of long, without padding)
    and the offsets at which pieces begin (for position ids and attention
    masks)."""
    found = placed.select("piece", "sequence_id", "offset").join(
        pieces.select(piece_name().alias("piece"), "ids"), "piece")
    one = F.struct("offset", F.hex("ids").alias("ids"))
    rows = found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    digits = F.array_join(F.transform("p", lambda x: x["ids"]), "")

    def value(i):  # eight hex digits, lowest byte first
        at = i * 8 + 1
        pairs = [F.substring(digits, at + 2 * b, 2) for b in (3, 2, 1, 0)]
        return F.conv(F.concat(*pairs), 16, 10).cast("long")

    n = (F.length(digits) / 8).cast("int")
    return rows.select("sequence_id", F.transform(F.sequence(F.lit(0), n - 1), value).alias("ids"),
                       F.transform("p", lambda x: x["offset"]).alias("offsets"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 ids."""
    import public_tokenizers
    _, placed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")
