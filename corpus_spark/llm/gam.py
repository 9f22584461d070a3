"""Quality classifier: a generalised additive model with pairwise
interactions.

Each feature of a text is binned; cyclic boosting goes round the features and
adds, for each in turn, a tree of at most three leaves over its bins to the
feature's lookup table; the pairs of features whose joint bins explain most of
what is left get two-dimensional tables in the same way.  A score is the
logistic function of the sum of the looked-up entries.

The model is fitted on the driver to a bounded sample of labelled rows
(``max_rows``, chosen by a hash of doc_id); features are computed, and every
text is scored, in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, distinct_per_text, documents, hash_spans, lowest_hashes, slices, text_buffer
from .line_quality import text_statistics

#: Labelled rows to fit on, at most.
MAX_ROWS = 20_000

# --- features ------------------------------------------------------------------------

FEATURES = (
    "log_chars", "log_words", "word_length", "words_per_line", "dup_line_share", "repeat_share", "symbols_per_word",
    "distinct_word_share", "upper_share", "digit_share", "mark_share", "space_share", "wide_share", "control_share",
    "bangs_per_word", "stops_per_word", "short_word_share", "long_word_share", "lone_sign_share", "closed_line_share",
    "byte_entropy",
)

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_PUNCTUATION = np.array([c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)])
_CONTROL = np.array([c for c in range(32) if c not in (9, 10, 11, 12, 13)] + [127])
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".!?:;\"')"]] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all finite, also for empty texts."""
    n = len(offsets) - 1
    stats, lines = text_statistics(buf, offsets)
    starts, ends, first = lines["word_starts"], lines["word_ends"], lines["first"]
    sizes = np.diff(offsets)
    seen = np.bincount(np.repeat(np.arange(n) * 256, sizes) + buf, minlength=256 * n).reshape(n, 256).astype(float)
    chars = seen.sum(axis=1) - seen[:, 128:192].sum(axis=1)
    words = np.diff(first).astype(float)
    per = lambda a, b: a / np.maximum(b, 1)
    text_of_word = np.repeat(np.arange(n), np.diff(first))
    count = lambda flags: np.bincount(text_of_word, flags, n) if len(flags) else np.zeros(n)
    length = ends - starts
    alnum = np.concatenate(([0], np.cumsum(_ALNUM[buf])))
    _, apart = distinct_per_text(hash_spans(buf, starts, ends), first)
    n_lines = np.bincount(lines["text"], minlength=n).astype(float)
    # last word of each line: does it end in a closing mark
    last = np.append(np.searchsorted(starts, lines["start"])[1:], len(starts)) - 1
    closed = np.bincount(lines["text"], _CLOSING[buf[ends[last] - 1]], n) if len(last) else np.zeros(n)
    share = per(seen, seen.sum(axis=1)[:, None])
    entropy = -np.sum(share * np.log2(np.where(share > 0, share, 1)), axis=1)
    letters = seen[:, _UPPER].sum(axis=1) + seen[:, _LOWER].sum(axis=1)
    found = {
        "log_chars": np.log1p(chars), "log_words": np.log1p(words), "word_length": per(stats["word_chars"], words),
        "words_per_line": per(words, n_lines), "dup_line_share": per(stats["n_dup_lines"], n_lines),
        "repeat_share": per(stats["n_repeat_words"], words), "symbols_per_word": per(stats["n_symbols"], words),
        "distinct_word_share": per(np.diff(apart), words), "upper_share": per(seen[:, _UPPER].sum(axis=1), letters),
        "digit_share": per(seen[:, _DIGIT].sum(axis=1), chars),
        "mark_share": per(seen[:, _PUNCTUATION].sum(axis=1), chars),
        "space_share": per(seen[:, IS_SPACE].sum(axis=1), chars), "wide_share": per(seen[:, 192:].sum(axis=1), chars),
        "control_share": per(seen[:, _CONTROL].sum(axis=1), chars), "bangs_per_word": per(seen[:, 33], words),
        "stops_per_word": per(seen[:, 46], words), "short_word_share": per(count(length <= 3), words),
        "long_word_share": per(count(length >= 14), words),
        "lone_sign_share": per(count(alnum[ends] == alnum[starts]), words),
        "closed_line_share": per(closed, n_lines), "byte_entropy": entropy,
    }
    return np.stack([found[f] for f in FEATURES], axis=1)


# --- the model -------------------------------------------------------------------------

@dataclass
class Gam:
    """``edges`` bin a feature; ``tables`` hold a feature's additions by bin,
    ``pairs`` a pair's by both coarse bins (bin // ``coarse``)."""
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best ``(gain, position)`` to cut a row of bins in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g)**2 / (h.sum() - left_h + ridge) - g.sum()**2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    bounds = [0, len(g)]
    for _ in range(2):
        best = max(((*_cut(g[a:b], h[a:b], ridge), a) for a, b in zip(bounds, bounds[1:])), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        bounds = sorted([*bounds, best[2] + best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """``(gain, values)`` of a tree over two features' bins: one cut of the
    rows, then one of the columns on either side."""
    best, values = 0.0, np.zeros_like(g)
    base = g.sum()**2 / (h.sum() + ridge)
    rows_g, rows_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    for at in range(1, len(g)):
        total, out = -base, np.zeros_like(g)
        for side, sg, sh in ((slice(0, at), rows_g[at - 1], rows_h[at - 1]),
                             (slice(at, None), rows_g[-1] - rows_g[at - 1], rows_h[-1] - rows_h[at - 1])):
            gain, to = _cut(sg, sh, ridge)
            to = to if gain > 1e-9 else len(sg)
            for part in (slice(0, to), slice(to, None)):
                a, b = sg[part].sum(), sh[part].sum() + ridge
                out[side, part] = a / b
                total += a * a / b
        if total > best:
            best, values = total, out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 8,
        pair_rounds: int = 60, coarse: int = 4, ridge: float = 1.0) -> Gam:
    """Fit to feature rows ``x`` and labels ``y`` (0 or 1).  With no rows the
    model says 0.5 to every text; with one label only, (nearly) that label."""
    if not len(y):
        return Gam(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [], coarse)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), ridge)
            table += step
            total += step[b[:, j]]
    c, width = b // coarse, (bins - 1) // coarse + 1

    def joint(i, j, values):
        return np.bincount(c[:, i] * width + c[:, j], values, width * width).reshape(width, width)

    g, h = slopes()
    gains = sorted(((_grid(joint(i, j, g), joint(i, j, h), ridge)[0], i, j)
                    for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((width, width))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _grid(joint(i, j, g), joint(i, j, h), ridge)[1]
            table += step
            total += step[c[:, i], c[:, j]]
    return model


# --- Spark jobs ---------------------------------------------------------------------------

def is_held_out() -> Column:
    """Whether a model must not learn from a row: crc32 of doc_id as text, by
    3, leaves 1 (a null doc_id: held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Fit a model to at most ``max_rows`` labelled documents that are not
    held out, those whose doc_ids have the lowest hashes.  Rows with a null
    label or doc_id are left out.  The features of these rows, and nothing
    else, go to the driver."""
    chosen = labels.where(F.col(label).isNotNull() & ~is_held_out()) \
        .groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = lowest_hashes(chosen, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = features(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *(pa.array(found[:, j]) for j in range(len(FEATURES)))],
                    names=["doc_id", "label", *FEATURES])

    # at most max_rows rows of two numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label") \
        .mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    return fit(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float))


def score_documents(docs: DataFrame, model: Gam) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; more columns are ignored; null
    text: empty): doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(*text_buffer(part.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", "text", is_held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam) -> DataFrame:
    """The rows of ``docs``, all columns, that the model predicts as label 1."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                good = model.score(features(*text_buffer(part.column(at)))) >= 0.5
                yield part.filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model learned from ``labels``."""
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
