"""Language-model scores over a lattice of subword pieces.

The pieces are those of a public vocabulary file.  A text is the sequence of
its words, each with the mark of a word's beginning before it, and one end;
its probability is the sum over all ways to spell its words with pieces, each
piece drawn independently, computed with the forward recursion in log space.
A character can also be spelled by its bytes, so every text has a probability.

The file's scores order the pieces (a piece's score is minus its rank); they
give the weights to start from, 1 / (rank + 10).  Weights are then fitted to
the training words by expectation-maximisation: expected counts of all pieces
over all segmentations of every distinct training word, times its count.
Counting words and summing expected counts are Spark aggregations; only the
weights, one for each piece, come to the driver.

Beside the lattice score every text gets the score of an add-half unigram
model of whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (LOWER, HashIndex, documents, hash_spans, materialize, mix64, slices, text_buffer, word_spans)

ROUNDS = 4
SMOOTHING = 0.1
#: Word counts that are broadcast, those of the commonest words; the rest are joined.
COMMON_WORDS = 1 << 19
#: Words whose scores a worker keeps.
MAX_WORDS = 1 << 20
SLICE = 8 << 20
MARK = 0x2581  # begins a word in the vocabulary file
_NEVER = 0xFFFFFFFF
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 2**64)
LN10 = float(np.log(10))


# --- the lattice ----------------------------------------------------------------------

class Pieces:
    """The pieces of a vocabulary file and their places in words."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.vocab_size())
                if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = [model.id_to_piece(i) for i in kept]
        self.start = np.array([1 / (10 - model.get_score(i)) for i in kept])
        ok = [chr(MARK) not in t[1:] and t != "" for t in text]  # the mark begins a word and nothing else
        self.text = [t for t, k in zip(text, ok) if k]
        self.start = self.start[ok]
        self.longest = max(map(len, self.text))
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.text]
        width = np.zeros((len(codes), self.longest), np.uint32)
        for i, c in enumerate(codes):
            width[i, :len(c)] = c
        length = np.array([len(c) for c in codes])
        sums = self._prefix(width)
        keys = self._key(sums[np.arange(len(codes)), length], 0, length)
        self._index = HashIndex(1 << 17)
        self._index.add(keys)
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[keys & np.uint64((1 << 20) - 1)] = True
        self.n = len(self.text)

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        powers = np.cumprod(np.full(codes.shape[1], _STEP, np.uint64), dtype=np.uint64)
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=out[:, 1:], dtype=np.uint64)
        return out

    @staticmethod
    def _key(difference: np.ndarray, shift, length) -> np.ndarray:
        back = np.uint64(1) if isinstance(shift, int) else shift
        return mix64(difference * back + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """``out[l - 1, row, i]``: the piece of ``l`` characters that begins at
        character i of a word, -1 where none."""
        n, width = codes.shape
        sums = self._prefix(codes)
        back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(width, _BACK, np.uint64), dtype=np.uint64)))
        out = np.full((min(self.longest, width), n, width), -1, np.int32)
        for size in range(1, len(out) + 1):
            keys = self._key(sums[:, size:] - sums[:, :-size], back[:width + 1 - size], size).ravel()
            at = np.flatnonzero(self._maybe[keys & np.uint64((1 << 20) - 1)])
            flat = np.full(len(keys), -1, np.int32)
            flat[at] = self._index.find(keys[at])
            out[size - 1, :, :width + 1 - size] = flat.reshape(n, -1)
        return out


def word_codes(words: list[str], width: int) -> np.ndarray:
    """Code points of marked words, padded to ``width`` (a zero is padding and
    no character of a piece; the mark inside a word is never matched)."""
    out = np.full((len(words), width), _NEVER, np.uint32)
    length = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    flat[flat == MARK] = _NEVER - 1
    out[np.arange(width) < length[:, None] + 1] = np.insert(flat, np.concatenate(([0], np.cumsum(length)[:-1])), MARK)
    return out


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


class Lattice:
    """Log probabilities of words under piece weights: ``log_p`` has one entry
    for each piece, then all bytes together, then the end of a text."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self.end = float(log_p[-1])

    def _weights(self, codes: np.ndarray):
        found = self.pieces.edges(codes)
        weight = np.where(found >= 0, self.log_p[found], -np.inf)
        size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        size = np.where(codes == _NEVER - 1, 3, size)
        spelled = size * (self.log_p[-2] - np.log(256))  # a character by its bytes
        return found, weight, size, spelled

    def _forward(self, weight: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        n, width = spelled.shape
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        by_end = weight.transpose(0, 2, 1)
        one = np.logaddexp(by_end[0], spelled.T)
        for j in range(1, width + 1):
            k = min(len(weight), j)
            parts = np.empty((k, n))
            parts[0] = alpha[j - 1] + one[j - 1]
            for size in range(2, k + 1):
                parts[size - 1] = alpha[j - size] + by_end[size - 1, j - size]
            alpha[j] = _log_sum(parts)
        return alpha

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(positions, lengths with the mark, codes)`` of words in buckets of
        similar length and bounded size."""
        length = np.array([len(w) + 1 for w in words])
        width = np.where(length <= 32, length + 1 & ~1, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            step = max(1, (1 << 17) // w)
            for i in range(0, len(which), step):
                part = which[i:i + step]
                yield part, length[part], word_codes([words[j] for j in part], w)

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word."""
        out = np.zeros(len(words))
        for at, length, codes in self.batches(words):
            _, weight, _, spelled = self._weights(codes)
            alpha = self._forward(weight, spelled)
            out[at] = alpha[length, np.arange(len(at))]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece (and of bytes) in all
        segmentations of the words, times their counts."""
        out = np.zeros(len(self.log_p))
        for at, length, codes in self.batches(words):
            found, weight, size, spelled = self._weights(codes)
            n, width = codes.shape
            alpha = self._forward(weight, spelled)
            every = np.arange(n)
            total = alpha[length, every]
            beta = np.full((width + len(weight) + 1, n), -np.inf)
            beta[length, every] = 0
            by_start = weight.transpose(0, 2, 1)
            one = np.logaddexp(by_start[0], spelled.T)
            for i in range(width - 1, -1, -1):
                parts = np.empty((len(weight) + 1, n))
                parts[0] = beta[i + 1] + one[i]
                for s in range(2, len(weight) + 1):
                    parts[s - 1] = beta[i + s] + by_start[s - 1, i]
                parts[-1] = beta[i]  # the word ends here, or nothing follows
                top = parts.max(axis=0)
                with np.errstate(invalid="ignore"):
                    here = top + np.log(np.exp(parts - top).sum(axis=0))
                beta[i] = np.where(np.isfinite(top) & (i < length), here, beta[i])
            times = counts[at]
            for s in range(1, len(weight) + 1):
                ids = found[s - 1].T  # (width, n)
                i, r = np.nonzero(ids >= 0)
                use = np.exp(alpha[i, r] + by_start[s - 1, i, r] + beta[i + s, r] - total[r]) * times[r]
                out += np.bincount(ids[i, r], use, len(out))
            i, r = np.nonzero(np.arange(width)[:, None] < length[None, :])
            use = np.exp(alpha[i, r] + spelled[r, i] + beta[i + 1, r] - total[r]) * times[r]
            out[-2] += float((use * size[r, i]).sum())
        return out


# --- Spark jobs -----------------------------------------------------------------------

def is_held_out() -> Column:
    """Rows that are not learned from: crc32 of doc_id as text, by 5, leaves 1
    (a null doc_id: held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """Counts of the lower-cased words of the rows that are learned from: key
    (64-bit hash), word, c.  Words are counted in the tasks before they are
    shuffled, so a word that every text holds is one row a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                buf, offsets = text_buffer(part.column(0))
                low = LOWER[buf]
                starts, ends, _ = word_spans(low, offsets)
                keys, at, n = np.unique(hash_spans(low, starts, ends), return_index=True, return_counts=True)
                raw = low.tobytes()
                words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)],
                    names=["key", "word", "n"])
    found = docs.where(~is_held_out()).select("text").mapInArrow(run, "key long, word string, n long")
    return found.groupBy("key").agg(F.first("word").alias("word"), F.sum("n").alias("c"))


def fit(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log weights of pieces, bytes and the end, fitted to a written table of
    word counts and the number of texts."""
    pieces = _pieces(path)
    p = np.concatenate((pieces.start, [pieces.start.mean(), pieces.start.mean()]))
    for _ in range(rounds):
        log_p = np.log(p / p.sum())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(_pieces(path), log_p), None
            for batch in batches:
                for part in slices(batch, "word", 1 << 20):
                    got = lattice.expected(part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False).astype(float))
                    total = got if total is None else total + got
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        # one row for each piece
        rows = counts.select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        p = np.full(len(p), smoothing)
        p[[r["piece"] for r in rows]] += [r["n"] for r in rows]
        p[-1] += ends
    return np.log(p / p.sum())


_worker: dict = {}


def _pieces(path: str) -> Pieces:
    if path not in _worker:
        _worker[path] = Pieces(path)
    return _worker[path]


def score_texts(docs: DataFrame, path: str, rounds: int = ROUNDS, common_words: int = COMMON_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; more columns are ignored; null
    text: empty): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities).

    Counts of the commonest words, at most ``common_words``, are broadcast as
    two numbers each; all other words of a text are joined with the written
    counts.  Those keys are rare by construction, so no key is hot.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", is_held_out().alias("held_out"))
    counts = materialize(count_words(docs), "word-counts")
    ends = docs.where(~F.col("held_out")).select("held_out").count()
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, size = tokens + ends, words + (1 if ends else 0)
    whole = total + 0.5 * (size + 1)
    log_p = fit(counts, ends, path, rounds)
    # the least count such that no more words than wanted have it
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, room = None, common_words
    for r in sorted(steps, key=lambda r: -r["s"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    head = counts.where(F.col("c") >= (least if least is not None else 2**62)).select("key", "c").toPandas()
    shared = spark.sparkContext.broadcast((head["key"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(float), log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, weights = shared.value
        known = HashIndex(1 << 20)
        known.add(keys)
        base = np.log10((c + 0.5) / whole)
        lattice = Lattice(_pieces(path), weights)
        seen, scores = HashIndex(1 << 16), np.zeros(0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                buf, offsets = text_buffer(part.column(1))
                low = LOWER[buf]
                starts, stops, first = word_spans(low, offsets)
                distinct, at, inverse = np.unique(hash_spans(low, starts, stops), return_index=True, return_inverse=True)
                text = np.repeat(np.arange(n), np.diff(first))
                number = seen.find(distinct)
                if (number < 0).any():
                    if seen.n > MAX_WORDS:
                        seen, scores = HashIndex(1 << 16), np.zeros(0)
                        number[:] = -1
                    new = np.flatnonzero(number < 0)
                    raw = low.tobytes()
                    seen.add(distinct[new])
                    scores = np.concatenate((scores, lattice.score(
                        [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), stops[at[new]].tolist())])))
                    number = seen.find(distinct)
                score = np.bincount(text, scores[number][inverse], n) + lattice.end
                found = known.find(distinct)
                value = np.where(found >= 0, base[found] if len(base) else 0.0, 0.0)
                common = (found >= 0)[inverse]
                rare = np.flatnonzero(~common)
                pairs, times = np.unique(text[rare] * len(distinct) + inverse[rare], return_counts=True)
                to = np.searchsorted(pairs // max(1, len(distinct)), np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), part.column(0), part.column(2), pa.array(np.diff(first) + 1),
                     pa.array(np.bincount(text, common, n).astype(np.int64) + (1 if ends else 0)),
                     pa.array(np.bincount(text, value[inverse], n) + np.log10((ends + 0.5) / whole)),
                     pa.array(score / LN10),
                     pa.ListArray.from_arrays(pa.array(to), pa.array(distinct[pairs % max(1, len(distinct))].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(to), pa.array(times.astype(np.int64)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "keys", "times"])
                row += n

    scored = materialize(docs.mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
             "keys array<long>, times array<long>"), "scored-texts")
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")) \
        .select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    more = rare.join(counts.select("key", "c"), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(whole))).alias("more_score"))
    return scored.drop("keys", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_score", F.lit(0.0))).alias("base_score"), "score")


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and word-unigram scores of all documents."""
    import public_tokenizers
    return score_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
