"""Training a unigram-LM vocabulary on a ``(word, count)`` table.

1. Seeds: every substring that is frequent enough, counted in one aggregation
   over the distinct words; counts are combined before the shuffle.
2. Rounds of expectation-maximisation over all segmentations: forward and
   backward sums over every word's lattice give the expected count of each piece
   (Arrow batches, all words of one length position by position); partial counts
   are summed with ``groupBy``.  The likelihood of the words never falls.  Pieces
   only go, so the words' lattices are looked up once and written; a round reads
   them with new scores.
3. Pruning by loss: for each piece of several characters the likelihood that
   goes if its best segmentation by other pieces takes its place; the least loss
   goes first, until the size is reached.  Single characters always stay.

The pieces and their scores are broadcast; there are at most ``max_seeds``: a
corpus with more frequent substrings than that is mined with a higher count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written
from .encoders import UNKNOWN_PENALTY, Lattice, _char_starts, _words
from .vocab import resolve_vocab_size, special_tokens_table

#: Bytes of words, or cells of lattices, worked off at a time.
PIECE_BYTES = 1 << 18
SLICE_CELLS = 1 << 18
#: Smaller chances are computed by logarithms.
LEAST_CHANCE = 1e-250
#: Words of a partition in a round: each partition hands on up to a row for each piece.
PART_WORDS = 500_000


def frequent_substrings(words: DataFrame, min_count: int = 2, max_len: int = 16) -> DataFrame:
    """``(piece, count)`` of all substrings of 2 to ``max_len`` characters
    that stand at least ``min_count`` times in ``words`` (word, count)."""
    ensure_checkpoint_dir(words.sparkSession)
    length = F.length("word")
    return words.where(length > 1) \
        .select("word", "count", F.explode(F.sequence(F.lit(2), F.least(length, F.lit(max(max_len, 2))))).alias("size")) \
        .where(F.col("size") <= max_len) \
        .select("word", "count", "size", F.explode(F.sequence(F.lit(1), length - F.col("size") + 1)).alias("p")) \
        .groupBy(F.substr("word", F.col("p"), F.col("size")).alias("piece")).agg(F.sum("count").alias("count")) \
        .where(F.col("count") >= min_count).checkpoint()


def _longest(pieces: list[str]) -> int:
    return max(map(len, pieces), default=1)


def _row(size, width, i):
    """Where the cells of character ``i`` begin in a word: each character has
    one for every length up to ``width`` that the word still has room for."""
    over = np.maximum(i - 1 - (size - width), 0)
    return i * width - over * (over + 1) // 2


def lattice_cells(lattice: Lattice, longest: int, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cells, offsets of words in cells, characters of words)``: for each
    character of a word, and each length up to the word's end and to
    ``longest`` (characters of the longest piece), the piece that begins there, -1 where none does, -2 for a
    character that is not a piece."""
    start, end, piece, _ = lattice.edges(buf, off)
    before = np.append(0, np.cumsum((buf & 0xC0) != 0x80))  # characters before a byte
    size = np.diff(before[off])
    width = np.minimum(size, longest)
    at = np.append(0, np.cumsum(_row(size, width, size)))
    word = np.searchsorted(off, start, side="right") - 1
    cells = np.full(at[-1], -1, np.int32)
    row = _row(size[word], width[word], before[start] - before[off[word]])
    cells[at[word] + row + before[end] - before[start] - 1] = np.where(piece < 0, -2, piece)
    return cells, at, size


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


def _by_logs(cells: np.ndarray, size: int, width: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_shares` by logarithms, for words whose chances are too small for
    a float."""
    weight, row = weights[cells], _row(size, width, np.arange(size + 1))
    forward, backward = np.zeros((2, size + 1, cells.shape[1]))
    for j in range(1, size + 1):
        k = np.arange(min(width, j))
        forward[j] = _log_sum(forward[j - 1 - k] + weight[row[j - 1 - k] + k])
    share = np.zeros(cells.shape)
    for i in range(size - 1, -1, -1):
        here = slice(row[i], row[i + 1])
        parts = backward[i + 1:i + 1 + row[i + 1] - row[i]] + weight[here]
        backward[i] = _log_sum(parts)
        share[here] = np.exp(parts + (forward[i] - forward[size]))
    return share, forward[size]


def _shares(cells: np.ndarray, size: int, width: int, weights: np.ndarray,
            chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(share of each cell in the segmentations, log-likelihood)`` of words
    of ``size`` characters, a column of ``cells`` each; ``chances`` are
    exponentials of ``weights``."""
    share, row = chances[cells], _row(size, width, np.arange(size + 1)).tolist()
    forward, backward = np.zeros((2, size + 1, cells.shape[1]))
    forward[0] = backward[size] = 1.0
    for j in range(1, size + 1):
        for k in range(1, min(width, j) + 1):
            forward[j] += forward[j - k] * share[row[j - k] + k - 1]
    for i in range(size - 1, -1, -1):
        for k in range(row[i + 1] - row[i]):
            share[row[i] + k] *= backward[i + 1 + k]
            backward[i] += share[row[i] + k]
    small = np.flatnonzero(np.minimum(forward, backward).min(axis=0) < LEAST_CHANCE)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(size):
            share[row[i]:row[i + 1]] *= forward[i] / forward[size]
        likelihood = np.log(forward[size])
    if len(small):
        share[:, small], likelihood[small] = _by_logs(cells[:, small], size, width, weights)
    return share, likelihood


def _expected_of_words(cells: np.ndarray, at: np.ndarray, size: np.ndarray, longest: int, weights: np.ndarray,
                       counts: np.ndarray, total: np.ndarray) -> float:
    """The log-likelihood of words that occur ``counts`` times; adds the
    expected counts of the ``weights`` to ``total``."""
    likelihood, chances = 0.0, np.exp(weights)
    order = np.argsort(size, kind="stable")
    order = order[np.searchsorted(size[order], 1):]  # an empty word has no pieces
    bounds = np.flatnonzero(np.diff(size[order], prepend=0))
    for x, y in zip(bounds.tolist(), np.append(bounds[1:], len(order)).tolist()):
        n, each = int(size[order[x]]), int(at[order[x] + 1] - at[order[x]])
        step = max(1, SLICE_CELLS // each)
        for i in range(x, y, step):
            some = order[i:min(i + step, y)]
            if some[-1] - some[0] == len(some) - 1:  # they stand together
                part = cells[at[some[0]]:at[some[-1] + 1]].reshape(-1, each)
            else:
                part = cells[at[some][:, None] + np.arange(each)]
            part = np.ascontiguousarray(part.T)
            share, ll = _shares(part, n, min(n, longest), weights, chances)
            share *= counts[some]
            live = np.flatnonzero(share.ravel())
            np.add.at(total, part.ravel()[live], share.ravel()[live])
            likelihood += float(ll @ counts[some])
    return likelihood


def _weights(scores: np.ndarray) -> np.ndarray:
    """Scores by the numbers of cells: -2 is an unknown character, -1 nothing."""
    some = scores[np.isfinite(scores)]
    return np.append(scores, [(some.min() if len(some) else 0.0) - UNKNOWN_PENALTY, -np.inf])


def expected_counts(lattice: Lattice, buf: np.ndarray, off: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """``(expected count of each piece, log-likelihood)`` of words that occur
    ``counts`` times, over all their segmentations."""
    total = np.zeros(len(lattice.pieces) + 2)
    longest = _longest(lattice.pieces)
    likelihood = _expected_of_words(*lattice_cells(lattice, longest, buf, off), longest, _weights(lattice.scores), counts, total)
    return total[:-2], likelihood


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(batch.num_rows, PIECE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def word_lattices(words: DataFrame, lattice: Lattice) -> DataFrame:
    """``(count, size, cells)`` of words (word, count), written: characters
    and :func:`lattice_cells` (as bytes) of each.  Words of one length stand
    together."""
    spark = words.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, words.count() // PART_WORDS + 1)
    longest, shared = _longest(lattice.pieces), spark.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                cells, at, size = lattice_cells(shared.value, longest, *_words(part.column(0)))
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at * 4), pa.py_buffer(cells)])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(size), raw.cast(pa.binary())],
                                                 names=["count", "size", "cells"])

    out = written(words.select("word", "count").repartition(parts).sortWithinPartitions(F.length("word"))
                  .mapInArrow(run, "count long, size long, cells binary"), "word-lattices")
    shared.unpersist()
    return out


def expectation(lattices: DataFrame, longest: int, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """:func:`expected_counts` over :func:`word_lattices`, made with pieces of
    up to ``longest`` characters; pieces that are gone have the score minus
    infinity."""
    shared = lattices.sparkSession.sparkContext.broadcast(_weights(scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likelihood = np.zeros(len(shared.value)), 0.0
        for batch in batches:
            raw, at = _words(batch.column(2))
            likelihood += _expected_of_words(raw.view(np.int32), at // 4, batch.column(1).to_numpy(), longest, shared.value,
                                             batch.column(0).to_numpy().astype(float), total)
        some = np.flatnonzero(total[:-2])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], likelihood))],
                                         names=["piece", "n"])

    out = lattices.select("count", "size", "cells").mapInArrow(run, "piece long, n double").groupBy("piece") \
        .agg(F.sum("n").alias("n")).toPandas()  # a row for each piece
    shared.unpersist()
    counts = np.zeros(len(scores))
    known = out["piece"].to_numpy() >= 0
    counts[out["piece"].to_numpy()[known]] = out["n"].to_numpy()[known]
    return counts, float(out["n"].to_numpy()[~known].sum())


def losses(spark, lattice: Lattice, counts: np.ndarray) -> np.ndarray:
    """Likelihood that is lost if a piece goes: its expected count times what
    its best segmentation by other pieces scores less."""
    shared = spark.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i in range(0, len(ids), 20_000):
                some = ids[i:i + 20_000]
                buf, off = _words(pa.array([model.pieces[k] for k in some.tolist()], pa.string()))
                _, _, best, _ = model.best_paths(buf, off, whole=False)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best)], names=["id", "best"])

    out = spark.range(len(lattice.pieces)).mapInArrow(run, "id long, best double").toPandas()
    shared.unpersist()
    best = np.empty(len(counts))
    best[out["id"].to_numpy()] = out["best"].to_numpy()
    return counts * (lattice.scores - best)


def _steady(values: np.ndarray) -> np.ndarray:
    """Values without their last digits, which depend on the order of sums:
    what is equal but for those is ordered by its piece."""
    part, power = np.frexp(values)
    return np.ldexp(np.round(part, 10), power)


def train_unigram(freqs: DataFrame, vocab_size: int | str, specials: dict | None = None, max_piece_len: int = 16,
                  min_count: int = 2, max_seeds: int = 1_000_000, em_rounds: int = 2, shrink: float = 0.6,
                  corpus: DataFrame | None = None, trace: list | None = None) -> DataFrame:
    """``(piece, id, score)`` with the reserved special tokens first, then the
    pieces by falling score.  ``vocab_size`` may be ``"auto"`` (then ``corpus``
    has the texts); a size that the characters do not fit in is an error.
    ``trace`` gets (pieces, log-likelihood) of every round."""
    spark = freqs.sparkSession
    ensure_checkpoint_dir(spark)
    size = resolve_vocab_size(vocab_size, corpus)
    words = freqs.filter(F.length("word") > 0).select("word", F.col("count").cast("long").alias("count")).checkpoint()
    reserved = special_tokens_table(spark, specials)
    n_special = reserved.count()
    chars = {r["c"]: float(r["n"]) for r in words.select(F.explode(F.split("word", "")).alias("c"), "count")
             .groupBy("c").agg(F.sum("count").alias("n")).collect()}  # the alphabet
    target = size - n_special
    if len(chars) > target:
        raise ValueError(f"vocab_size {size} is too small: {n_special} special tokens and "
                         f"{len(chars)} characters need {n_special + len(chars)}")
    found = frequent_substrings(words, min_count, max_piece_len)
    levels = [min_count << k for k in range(60) if min_count << k < 1 << 62]
    enough = found.agg(*[F.count_if(F.col("count") >= level) for level in levels]).first()
    min_count = next(level for level, n in zip(levels, enough) if n <= max_seeds)
    seeds = found.where(F.col("count") >= min_count).orderBy("piece").toArrow()  # at most max_seeds
    pieces = sorted(chars) + seeds.column("piece").to_pylist()
    seen = np.append([chars[c] for c in sorted(chars)], seeds.column("count").to_numpy()).astype(float)
    every, left = len(pieces), np.arange(len(pieces))  # numbers of the pieces that are left
    longest = _longest(pieces)
    if every:
        lattices = word_lattices(words, Lattice(dict.fromkeys(pieces, 0.0)))
    while len(pieces):
        for _ in range(em_rounds):
            seen = np.maximum(seen, 1e-9)
            scores = np.full(every, -np.inf)
            scores[left] = np.log(seen / seen.sum())
            seen, likelihood = expectation(lattices, longest, scores)
            seen = seen[left]
            if trace is not None:
                trace.append((len(pieces), likelihood))
        multi = np.array([len(p) > 1 for p in pieces])
        if len(pieces) <= target:
            break
        seen = np.maximum(seen, 1e-9)
        lattice = Lattice(dict(zip(pieces, np.log(seen / seen.sum()))))
        loss = np.where(multi, losses(spark, lattice, seen), np.inf)
        keep = max(target, int(len(chars) + multi.sum() * shrink))
        stay = np.sort(np.lexsort((np.array(pieces), -_steady(loss)))[:keep])
        pieces, seen, left = [pieces[i] for i in stay.tolist()], seen[stay], left[stay]
    seen = np.maximum(seen, 1e-9)
    score = np.log(seen / seen.sum()) if len(pieces) else seen
    order = np.lexsort((np.array(pieces), -_steady(score))) if len(pieces) else []
    body = spark.createDataFrame([(pieces[i], n_special + k, float(score[i])) for k, i in enumerate(order)],
                                 "piece string, id long, score double")
    return reserved.select("piece", "id", F.lit(0.0).alias("score")).unionByName(body)
