"""Language re-balancing by weighted interleaving, round-robin interleaving
and fixed-size text batches.

Interleaving with probabilities follows the public semantics of
interleaving datasets: at every output position a language is drawn with
its probability and that language's next row is emitted.  ``first_exhausted``
stops after the first language has emitted its last row;
``all_exhausted`` continues (restarting exhausted languages from their first
row) until every language has emitted its last row at least once.

Spark formulation: the draw for position t is a seeded hash of t compared
with the cumulative probabilities (a pure function, so no sequential RNG);
the k-th draw of language L takes L's row k mod n_L.  As a draw depends on t
alone, draws are never sorted, shuffled or stored: positions are cut into at
most ``BLOCKS`` blocks, draws are counted per block and language, the counts of
the blocks before are added up, and a task numbers the draws of its block as they
come.  The stop position is that of a language's n_L-th draw, looked up in the one
block that holds it.  "Row k" is an exact per-group row index
(:mod:`.rowindex`); output rows come from an equi-join on ``(language, row
index)``.
"""

from __future__ import annotations

import math
from typing import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .rowindex import MAX_BROADCAST_ROWS, group_counts, group_row_index
from .stats import sampling_probs_list


#: Equal slices of [0, 1) by which a draw finds its language.
SLICES = 4096
#: Most blocks of positions, and the least positions of a block.
BLOCKS = 4096
BLOCK = 1 << 16


def _draws(spark, end: int, langs: list[str], probs: list[float], seed: int, first: int = 0,
           block: int | None = None) -> DataFrame:
    """Positions ``first`` to ``end`` (in whole blocks, one for each task) with
    the language drawn at each (hash of seed and t) and its number.

    A language owns the interval of its probability; every interval is listed
    under the slices it touches (at most ``SLICES`` + languages rows, which are
    broadcast), and a draw looks only at those of its own slice."""
    block = block or end - first
    rows, lo = [], 0.0
    for i, p in enumerate(probs):
        hi = 2.0 if i == len(probs) - 1 else lo + p
        low, last = int(lo * SLICES), min(SLICES - 1, int(hi * SLICES))
        rows += [(s, i, langs[i], lo, hi) for s in range(low, last + 1) if hi > lo]
        lo = hi
    owners = spark.createDataFrame(rows, "slice int, lang int, language string, lo double, hi double")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"draw{seed}"), F.col("id").cast("string"))), 1, 13),
                16, 10).cast("double") / F.lit(float(1 << 52)))
    drawn = spark.range(first, end, 1, (end - first) // block).select(F.col("id").alias("t"), u.alias("u")) \
        .withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
    return drawn.join(F.broadcast(owners), "slice").filter("u >= lo and u < hi") \
        .select("t", F.floor(F.col("t") / block).cast("int").alias("block"), "lang", "language")


def _numbered(draws: DataFrame, n_langs: int) -> DataFrame:
    """``(t, block, lang, k)``: the how-manieth draw of its language in its
    block each is.  A task gets the positions of whole blocks in order."""
    def run(batches):
        at, seen = -1, np.zeros(n_langs, np.int64)
        for batch in batches:
            block, lang = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            k = np.zeros(len(lang), np.int64)
            for b in np.unique(block).tolist():
                if b != at:
                    at, seen = b, np.zeros(n_langs, np.int64)
                here = np.flatnonzero(block == b)
                order = here[np.argsort(lang[here], kind="stable")]
                size = np.bincount(lang[order], minlength=n_langs)
                begins = np.cumsum(size) - size
                k[order] = np.arange(len(order)) - begins[lang[order]] + seen[lang[order]]
                seen = seen + size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], names=["t", "block", "lang", "k"])
    return draws.select("t", "block", "lang").mapInArrow(run, "t long, block int, lang int, k long")


def interleave_by_probability(df: DataFrame, probabilities: Mapping[str, float],
                              stopping_strategy: str = "all_exhausted", seed: int = 42,
                              language_col: str = "language", id_col: str = "id") -> DataFrame:
    """Interleave the languages of ``df`` with the given probabilities.
    Returns the emitted rows with their output position ``t``."""
    if stopping_strategy not in ("all_exhausted", "first_exhausted"):
        raise ValueError(f"Invalid interleaving strategy: {stopping_strategy}")
    spark = df.sparkSession
    counts = {k[0]: v for k, v in group_counts(df, [language_col]).items()}
    langs = sorted(counts)
    missing = [l for l in langs if l not in probabilities]
    if missing:
        raise ValueError(f"Probabilities must cover all languages: missing {missing}")
    probs = [float(probabilities[l]) for l in langs]
    live = [l for l, p in zip(langs, probs) if p > 0]
    if not live:
        raise ValueError("All probabilities are zero.")
    # expected draws until every (or the first) language is exhausted, doubled until enough
    need = [counts[l] / probabilities[l] for l in live]
    T = int(math.ceil((max(need) if stopping_strategy == "all_exhausted" else min(need)) * 1.2)) + 64
    rows = spark.createDataFrame([(i, l, counts[l]) for i, l in enumerate(langs)], "lang int, language string, n long")
    first_only = stopping_strategy == "first_exhausted"
    while True:
        blocks = max(1, min(BLOCKS, math.ceil(T / BLOCK)))
        block = math.ceil(T / blocks)
        # one row for each block and language: draws of the blocks before, and of this one
        per_block = written(
            _draws(spark, blocks * block, langs, probs, seed, block=block).groupBy("block", "lang").agg(F.count(F.lit(1)).alias("c"))
            .withColumn("before", F.sum("c").over(Window.partitionBy("lang").orderBy("block")) - F.col("c")), "draw-counts")
        last = {langs[r["lang"]]: r for r in per_block.join(F.broadcast(rows), "lang")
                .filter("before < n and n <= before + c").select("lang", "block", (F.col("n") - 1 - F.col("before")).alias("k"))
                .collect()}
        if (first_only and any(l in last for l in live)) or all(l in last for l in live):
            break
        T *= 2
    # the first or last block in which a language ends; the place is looked up there
    pick = min if first_only else max
    b = pick(last[l]["block"] for l in live if l in last)
    ends = spark.createDataFrame([(r["lang"], r["k"]) for r in last.values() if r["block"] == b], "lang int, k long")
    stop = pick(r["t"] for r in _numbered(_draws(spark, (b + 1) * block, langs, probs, seed, b * block, block), len(langs))
                .join(F.broadcast(ends), ["lang", "k"]).select("t").collect())
    offsets = per_block.filter(F.col("block") <= b).select("block", "lang", "before")
    small = (b + 1) * len(langs) <= MAX_BROADCAST_ROWS
    wanted = (_numbered(_draws(spark, (b + 1) * block, langs, probs, seed, block=block).filter(F.col("t") <= stop), len(langs))
              .join(F.broadcast(offsets) if small else offsets, ["block", "lang"]).join(F.broadcast(rows), "lang")
              .select("t", F.col("language").alias(language_col), ((F.col("k") + F.col("before")) % F.col("n")).alias("row_idx")))
    indexed = group_row_index(df.select(language_col, id_col), [language_col], [id_col], "row_idx")
    chosen = wanted.join(indexed, on=[language_col, "row_idx"], how="inner").select("t", id_col)
    return df.join(chosen, id_col)  # the texts are read once, by id


def apply_language_sampling(df: DataFrame, sampling_strategy: str = "uniform", temperature: float = 1.0,
                            interleaving_strategy: str = "all_exhausted", raw_weights: Mapping | None = None,
                            seed: int = 42, language_col: str = "language", id_col: str = "id") -> DataFrame:
    """Probabilities from document counts (or user ``raw_weights``, which
    must cover every language), then :func:`interleave_by_probability`."""
    counts = {k[0]: v for k, v in group_counts(df, [language_col]).items()}
    langs = sorted(counts)
    if raw_weights is not None:
        if not all(l in raw_weights for l in langs):
            raise ValueError(f"raw_weights lack weights of {[l for l in langs if l not in raw_weights]}")
        weights = [raw_weights[l] for l in langs]
    else:
        weights = [counts[l] for l in langs]
    probs = sampling_probs_list(weights, sampling_strategy, temperature)
    return interleave_by_probability(df, dict(zip(langs, probs)), interleaving_strategy, seed,
                                     language_col, id_col)


def interleave_round_robin(df: DataFrame, group_col: str = "source", id_col: str = "id") -> DataFrame:
    """Alternate groups one row at a time (groups in sorted order), stopping
    when the smallest group runs out; adds the output position ``t``."""
    counts = {k[0]: v for k, v in group_counts(df, [group_col]).items()}
    groups = sorted(counts)
    m = min(counts.values())
    rank = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))])
    idx = group_row_index(df.select(group_col, id_col), [group_col], [id_col], "__i")
    place = idx.filter(F.col("__i") < m).select(
        id_col, (F.col("__i") * F.lit(len(groups)) + F.element_at(rank, F.col(group_col))).alias("t"))
    return df.join(place, id_col)


def text_batches(df: DataFrame, batch_size: int = 10_000, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Consecutive batches of ``batch_size`` texts in id order: ``(batch_id, texts)``.
    Every group holds at most ``batch_size`` rows by construction."""
    idx = df.select(id_col, text_col).join(group_row_index(df.select(id_col), None, [id_col], "__i"), id_col)
    return (idx.withColumn("batch_id", F.floor(F.col("__i") / F.lit(batch_size)).cast("long"))
            .groupBy("batch_id")
            .agg(F.sort_array(F.collect_list(F.struct("__i", text_col))).alias("__b"))
            .select("batch_id", F.transform("__b", lambda s: s[text_col]).alias("texts")))
