"""Corpus statistics: deletion reports, per-language counts, sampling
probabilities, vocabulary-size prediction."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("uniform", "proportional", "inverse_proportional", "inverse_proportional_sqrt", "temperature")


def size_summary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents, characters (code points) and UTF-8 bytes."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("docs"),
                  F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias("chars"),
                  F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("bytes"))


def deletion_report(before: DataFrame, after: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents / characters / bytes removed by a step, absolute and in
    percent.  Both tables are tagged and unioned into ONE aggregate (no join);
    no text ever reaches the driver."""
    t = (before.select(F.lit(0).alias("__side"), F.col(text_col).alias("__t"))
         .unionByName(after.select(F.lit(1).alias("__side"), F.col(text_col).alias("__t"))))
    aggs = []
    for side, name in ((0, "before"), (1, "after")):
        on = F.col("__side") == side
        aggs += [F.count_if(on).cast("long").alias(f"docs_{name}"),
                 F.coalesce(F.sum(F.when(on, F.length("__t"))), F.lit(0)).cast("long").alias(f"chars_{name}"),
                 F.coalesce(F.sum(F.when(on, F.octet_length("__t"))), F.lit(0)).cast("long").alias(f"bytes_{name}")]
    j = t.agg(*aggs)
    out = []
    for c in ("docs", "chars", "bytes"):
        removed = (F.col(f"{c}_before") - F.col(f"{c}_after")).cast("long")
        out += [removed.alias(f"removed_{c}"),
                F.when(F.col(f"{c}_before") > 0, F.round(removed * 100.0 / F.col(f"{c}_before"), 6))
                .otherwise(F.lit(0.0)).alias(f"removed_{c}_pct")]
    return j.select(*out)


def corpus_stats(df: DataFrame, language_col: str = "language", text_col: str = "text") -> DataFrame:
    """Documents and characters per language."""
    return df.groupBy(language_col).agg(F.count(F.lit(1)).cast("long").alias("docs"),
                                        F.sum(F.length(text_col)).cast("long").alias("chars"))


def distinct_languages(df: DataFrame, language_col: str = "language") -> DataFrame:
    return df.select(language_col).distinct()


def sampling_probs(weights: DataFrame, strategy: str = "uniform", temperature: float = 1.0,
                   key: str = "language", weight: str = "weight") -> DataFrame:
    """Sampling probability per key from raw weights (counts, characters ...).

    ``uniform`` 1/k, ``proportional`` w/sum, ``inverse_proportional``
    (1/w)/sum, ``inverse_proportional_sqrt`` (1/sqrt w)/sum, ``temperature``
    w^(1/T)/sum.  One aggregate over a table with one row per key."""
    w = F.col(weight).cast("double")
    if strategy == "uniform":
        raw = F.lit(1.0)
    elif strategy == "proportional":
        raw = w
    elif strategy == "inverse_proportional":
        raw = F.lit(1.0) / w
    elif strategy == "inverse_proportional_sqrt":
        raw = F.lit(1.0) / F.sqrt(w)
    elif strategy == "temperature":
        raw = F.pow(w, F.lit(1.0 / temperature))
    else:
        raise ValueError(f"Invalid strategy: {strategy}")
    t = weights.select(key, raw.alias("__raw"))
    total = t.agg(F.sum("__raw")).first()[0]   # one number; the key table is small
    return t.select(key, (F.col("__raw") / F.lit(total)).alias("prob"))


def sampling_probs_list(raw_weights: Sequence[float], strategy: str = "uniform", temperature: float = 1.0):
    """Plain-Python version for a handful of languages (used by the sampler)."""
    if strategy == "uniform":
        raw = [1.0] * len(raw_weights)
    elif strategy == "proportional":
        raw = [float(w) for w in raw_weights]
    elif strategy == "inverse_proportional":
        raw = [1.0 / w for w in raw_weights]
    elif strategy == "inverse_proportional_sqrt":
        raw = [1.0 / math.sqrt(w) for w in raw_weights]
    elif strategy == "temperature":
        raw = [w ** (1.0 / temperature) for w in raw_weights]
    else:
        raise ValueError(f"Invalid strategy: {strategy}")
    s = sum(raw)
    return [r / s for r in raw]


# ---------------------------------------------------------------------------
# Heaps'-law vocabulary prediction constants
# ---------------------------------------------------------------------------
HEAPS_K = 14.786406013978949
HEAPS_B = 0.5817526745145639
HEAPS_RATIO = 0.027731383953247812


def predict_vocab_size(df: DataFrame, ratio: float = HEAPS_RATIO, text_col: str = "text") -> DataFrame:
    """Vocabulary size predicted from the corpus' total characters:
    int(k * chars^b * ratio) (Heaps' law)."""
    return df.agg(F.sum(F.length(text_col)).cast("long").alias("chars")).select(
        "chars", F.floor(F.lit(HEAPS_K) * F.pow(F.col("chars").cast("double"), F.lit(HEAPS_B))
                         * F.lit(ratio)).cast("long").alias("vocab_size"))
