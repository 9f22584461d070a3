"""Toxicity: a linear classifier on character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text's features are the character n-grams it holds (presence, not counts),
letters A-Z in lower case, all white space alike, hashed to ``2**BITS``
buckets.  For each bucket the labelled texts of either class that hold it are
counted; the smoothed logarithm of the ratio of both shares is the bucket's
scale.  The ``FEATURES`` buckets that say most about the label (by the
likelihood-ratio statistic of presence and label) are kept, and a logistic
regression with a ridge penalty is fitted on their scaled features.  A score is
the logistic function of the sum of weight times scale of a text's buckets.

Counting, feature extraction and scoring are Spark tasks.  The regression is
fitted on the driver to at most ``max_rows`` labelled texts, of which it gets
the numbers of the kept buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lowest_hashes, lowest_values, materialize, mix64, slices, text_buffer

#: Lengths of the n-grams, buckets (their logarithm to base 2), kept buckets.
ORDERS = (3, 4, 5, 6)
BITS = 20
FEATURES = 4096
#: Labelled texts to learn from, at most.
MAX_ROWS = 10_000
#: A text is toxic from this score on.
THRESHOLD = 0.3
SMOOTHING = 1.0
RIDGE = 1.0

_factors = np.random.default_rng(20250311).integers(0, 2**64, max(ORDERS) + 1, dtype=np.uint64) | np.uint64(1)


# --- features --------------------------------------------------------------------------

def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(code points, offsets)`` of texts given as UTF-8: A-Z in lower case,
    one sign for all white space of ASCII."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    points = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
    first = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offsets]
    return points, first


def ngram_buckets(points: np.ndarray, first: np.ndarray, orders: tuple[int, ...] = ORDERS,
                  bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order ``(places, buckets)`` of the n-grams that lie within one
    text; a text that is shorter has none of them."""
    n = len(points)
    wide = points.astype(np.uint64)
    end = np.repeat(first[1:], np.diff(first))
    total = np.zeros(n, np.uint64)
    for k in range(1, max(orders) + 1):
        if n < k:
            return
        total[:n - k + 1] += wide[k - 1:] * _factors[k - 1]
        if k in orders:
            places = np.flatnonzero(np.arange(n - k + 1) + k <= end[:n - k + 1])
            yield places, (mix64(total[places] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


def held_buckets(buf: np.ndarray, offsets: np.ndarray, number: np.ndarray | None = None, orders: tuple[int, ...] = ORDERS,
                 bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(texts, buckets)``, the distinct buckets of each text by text and
    bucket.  With ``number`` (one entry for each bucket, negative: not wanted)
    the numbers of the wanted ones."""
    points, first = code_points(buf, offsets)
    found = []
    for places, buckets in ngram_buckets(points, first, orders, bits):
        if number is not None:
            buckets = number[buckets]
            hit = buckets >= 0
            places, buckets = places[hit], buckets[hit]
        text = np.searchsorted(first, places, side="right") - 1
        found.append(np.unique(text << bits | buckets))
    keys = np.unique(np.concatenate([*found, np.zeros(0, np.int64)])).astype(np.int64)
    return keys >> bits, keys & ((1 << bits) - 1)


# --- the model -------------------------------------------------------------------------

def log_count_ratios(with_one: np.ndarray, with_zero: np.ndarray, ones: float, zeros: float,
                     smoothing: float = SMOOTHING) -> np.ndarray:
    """Logarithm of the share of texts of label 1 that hold a bucket over the
    share of those of label 0, both smoothed."""
    return np.log((with_one + smoothing) / (ones + 2 * smoothing)) - np.log((with_zero + smoothing) / (zeros + 2 * smoothing))


def likelihood_ratio(with_one: Column, with_zero: Column, ones: int, zeros: int) -> Column:
    """Statistic of the independence of presence and label."""
    total, held = ones + zeros, with_one + with_zero
    out = F.lit(0.0)
    for seen, row, label in ((with_one, held, ones), (with_zero, held, zeros),
                             (ones - with_one, total - held, ones), (zeros - with_zero, total - held, zeros)):
        expected = row * (label / max(total, 1))
        out = out + F.when((seen > 0) & (expected > 0), 2 * seen * F.ln(seen / expected)).otherwise(0.0)
    return out


@dataclass
class Toxicity:
    """``number`` maps buckets to kept ones (-1: not kept); ``effect`` is
    weight times log-count ratio of each kept bucket."""
    intercept: float
    number: np.ndarray
    effect: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text."""
        text, kept = held_buckets(buf, offsets, self.number, self.orders, self.bits)
        total = self.intercept + np.bincount(text, self.effect[kept], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, columns: int,
                 ridge: float = RIDGE, steps: int = 25) -> tuple[float, np.ndarray]:
    """Intercept and weights of the ridge-penalised logistic regression on a
    sparse matrix (entries ``value`` at ``row``, ``column``): Newton steps,
    each solved by conjugate gradients."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(columns + 1)
    w[-1] = np.log(share / (1 - share))
    penalty = np.append(np.full(columns, ridge), 1e-6)

    def times(v):
        return np.bincount(row, value * v[column], n) + v[-1]

    def back(u):
        return np.append(np.bincount(column, value * u[row], columns), u.sum())

    def loss(v):
        s = times(v) * (2 * y - 1)
        return np.logaddexp(0, -s).sum() + (penalty * v * v).sum() / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = back(p - y) + penalty * w
        if np.abs(slope).max() < 1e-6 * max(n, 1):
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -slope
        d, rr = r.copy(), float(r @ r)
        for _ in range(50):
            hd = back(curve * times(d)) + penalty * d
            a = rr / float(d @ hd)
            step += a * d
            r -= a * hd
            new = float(r @ r)
            if new < 1e-6 * float(slope @ slope):
                break
            d, rr = r + (new / rr) * d, new
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, before):
            break
    return float(w[-1]), w[:-1]


# --- Spark jobs ------------------------------------------------------------------------

def is_held_out() -> Column:
    """Whether a model must not learn from a row: crc32 of doc_id as text, by
    4, leaves 2 (a null doc_id: held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text and label of at most ``max_rows`` different (doc_id, text) that
    have a label and are not held out, those with the lowest hashes; rows with
    a null label or doc_id are left out, of several labels of a doc_id the
    greatest counts.  Only ids and hashes are ordered and broadcast."""
    chosen = labels.where(F.col(label).isNotNull() & ~is_held_out()) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = F.broadcast(lowest_hashes(chosen, max_rows))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id") \
        .select("text", "label", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"))
    few = F.broadcast(lowest_values(rows.select("h"), max_rows))
    return materialize(rows.join(few, "h").groupBy("h").agg(F.first("text").alias("text"), F.first("label").alias("label")),
                       "labelled-texts")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, features: int = FEATURES,
          orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Toxicity:
    """Learn from labelled texts (see :func:`labelled_texts`; null texts are
    empty).  Without any, the model says 0.5 to every text; with one label
    only, (nearly) that label."""
    texts = labelled_texts(docs, labels, label, max_rows).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch):
                y = part.column(1).to_numpy() > 0
                text, bucket = held_buckets(*text_buffer(part.column(0)), None, orders, bits)
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[y[text] == k], minlength=1 << bits)
        some = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(some), 100_000):
            at = some[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])],
                                             names=["bucket", "zero", "one"])

    sizes = {r["label"]: r["n"] for r in texts.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(True, 0), sizes.get(False, 0)
    # a bucket that fewer than three labelled texts hold tells nothing
    counted = texts.mapInArrow(count, "bucket int, zero long, one long").groupBy("bucket") \
        .agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).where(F.col("zero") + F.col("one") > 2)
    told = F.round(likelihood_ratio(F.col("one"), F.col("zero"), ones, zeros), 6)
    best = counted.orderBy(told.desc(), "bucket").limit(features).toPandas().sort_values("bucket")
    number = np.full(1 << bits, -1, np.int32)
    number[best["bucket"].to_numpy()] = np.arange(len(best))
    ratio = log_count_ratios(best["one"].to_numpy(float), best["zero"].to_numpy(float), ones, zeros)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, kept = held_buckets(*text_buffer(part.column(0)), number, orders, bits)
                at = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(at), pa.array(kept.astype(np.int16))), part.column(1)],
                    names=["kept", "label"])

    if features > 1 << 15:
        raise ValueError("at most 32768 features")
    rows = texts.mapInArrow(extract, "kept array<short>, label int").toArrow()  # at most max_rows rows of kept buckets
    lists = rows.column("kept").combine_chunks()
    y = (rows.column("label").to_numpy() > 0).astype(float)
    if not len(y):
        return Toxicity(0.0, number, np.zeros(0), orders, bits)
    column = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    intercept, weights = fit_logistic(row, column, ratio[column], y, len(best))
    return Toxicity(intercept, number, weights * ratio, orders, bits)


def score_documents(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; more columns are ignored; null
    text: empty): doc_id, held_out, score, predicted.  Repeated rows are scored
    each; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(*text_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", "text", is_held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model learned from ``labels``."""
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
