"""Threshold filtering on quality signals (fixed, preset or estimated)."""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import GOPHER_THRESHOLDS, get_metric
from ..session import written
from .metrics import compute_metrics, drop_metric_columns


def _passes(metric: str, threshold: float) -> Column:
    m = get_metric(metric)
    c = F.col(metric)
    cond = c >= F.lit(threshold) if m.higher_is_better else c <= F.lit(threshold)
    return F.coalesce(cond, F.lit(False))   # NULL (undefined metric) fails


def threshold_predicate(thresholds: dict) -> Column:
    cond = F.lit(True)
    for name, t in thresholds.items():
        cond = cond & _passes(name, t)
    return cond


def apply_threshold(df: DataFrame, thresholds: dict, keep_columns: bool = False,
                    text_col: str = "text", tokenizer: Callable[[Column], Column] | None = None,
                    id_col: str = "id", seed: int = 42) -> DataFrame:
    """Keep documents whose every higher-is-better metric is >= its threshold and
    every lower-is-better metric is <= its threshold.  A threshold may be the
    string ``"auto"``: it is then estimated from the metric's distribution
    (:func:`auto_threshold`).  The caller's dict is not modified."""
    if df.isStreaming and any(v == "auto" for v in thresholds.values()):
        raise ValueError("auto thresholds need the whole table; not available on a stream")
    df = compute_metrics(df, thresholds.keys(), text_col, tokenizer)
    resolved = dict(thresholds)
    for name, t in thresholds.items():
        if t == "auto":
            resolved[name] = auto_threshold(df, name, id_col=id_col, seed=seed)
    out = df.filter(threshold_predicate(resolved))
    return drop_metric_columns(out, thresholds.keys(), keep_columns)


def gopher_threshold(df: DataFrame, keep_columns: bool = False, **kw) -> DataFrame:
    return apply_threshold(df, GOPHER_THRESHOLDS, keep_columns=keep_columns, **kw)


def threshold_report(df: DataFrame, thresholds: dict, text_col: str = "text") -> DataFrame:
    """One row: for every metric, how many documents its threshold removes
    (columns ``removed_<metric>``), plus the total of documents removed."""
    df = compute_metrics(df, thresholds.keys(), text_col)
    aggs = [F.count_if(~_passes(n, t)).cast("long").alias(f"removed_{n}") for n, t in thresholds.items()]
    aggs.append(F.count_if(~threshold_predicate(thresholds)).cast("long").alias("removed_total"))
    aggs.append(F.count(F.lit(1)).cast("long").alias("docs"))
    return df.agg(*aggs)


# ---------------------------------------------------------------------------
# Estimated ("auto") thresholds
# ---------------------------------------------------------------------------
HIST_BINS = 2048
#: Points on which the densities are compared, at every size of the corpus;
#: then as many again between the neighbours of the best one.
GRID_POINTS = 2048


def _kde_on_grid(centers: np.ndarray, counts: np.ndarray, n: int, std: float, grid: np.ndarray) -> np.ndarray:
    """Gaussian KDE (Scott's bandwidth) evaluated on a grid from a binned sample."""
    if n < 2 or std <= 0:
        return np.zeros_like(grid)
    bw = std * n ** (-1.0 / 5.0)
    z = (grid[:, None] - centers[None, :]) / bw
    dens = (np.exp(-0.5 * z * z) * counts[None, :]).sum(axis=1)
    return dens / (n * bw * math.sqrt(2 * math.pi))


def auto_threshold(df: DataFrame, metric: str, id_col: str = "id", seed: int = 42) -> float:
    """Estimate a threshold for ``metric``.

    The lowest 5 % of values (higher-is-better) or the values above the 5 %
    point (lower-is-better) form the *tail*; a seeded hash sample of the same
    size is the reference.  Both are summarised on Spark as fixed-size
    histograms (``HIST_BINS`` bins) plus moments; the two Gaussian KDEs are
    compared on ``GRID_POINTS`` points on the driver, then once more between
    the neighbours of the best one, and the threshold is the point where the
    tail density exceeds the sample density the most (least, for
    lower-is-better metrics).  Nothing that grows with the corpus reaches the
    driver.
    """
    from .cutpoint import find_cuts
    from .splits import seeded_key

    hib = get_metric(metric).higher_is_better
    # values are written once: every step below reads them again, and texts are measured once only
    base = written(df.select(F.col(metric).cast("double").alias("v"), F.col(id_col).alias("id")), "auto-threshold") \
        .filter(F.col("v").isNotNull())
    total = base.count()
    n = int(total * 0.05)
    if n < 2:
        # too few documents for a density estimate: remove nothing
        mm = base.agg(F.min("v"), F.max("v")).first()
        return float(mm[0] if hib else mm[1]) if mm[0] is not None else 0.0
    # tail membership by the exact cut on (value, id)
    cuts = find_cuts(base, "v", "id", None, n)
    cut = cuts[()]
    from .cutpoint import low_predicate
    in_low = low_predicate("v", "id", cut)
    tail = base.filter(in_low if hib else ~in_low)
    n_tail = n if hib else total - n
    # seeded sample of n rows: smallest n hash ranks
    hashed = base.select("v", "id", seeded_key("id", seed).cast("double").alias("h"))
    scut = find_cuts(hashed, "h", "id", None, n)[()]
    sample = hashed.filter(low_predicate("h", "id", scut)).select("v")

    t_stats = tail.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.stddev_samp("v").alias("sd"),
                       F.var_pop("v").alias("var"), F.count_if(F.col("v") == 0).alias("zeros"),
                       F.first("v").alias("any")).first()
    if t_stats["var"] is None or t_stats["var"] < 1e-10:
        return float(t_stats["mn"] if hib else t_stats["mx"])
    if t_stats["zeros"] > 0.9 * n_tail:
        return 0.0
    s_stats = sample.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.stddev_samp("v").alias("sd")).first()
    lo = min(t_stats["mn"], s_stats["mn"])
    hi = max(t_stats["mx"], s_stats["mx"])
    width = (hi - lo) / HIST_BINS if hi > lo else 1.0

    def hist(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(HIST_BINS - 1)).cast("int")
        rows = frame.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        counts = np.zeros(HIST_BINS)
        for r in rows:
            counts[r["b"]] += r["c"]
        centers = lo + (np.arange(HIST_BINS) + 0.5) * width
        return centers, counts

    tc, tcnt = hist(tail)
    sc, scnt = hist(sample)
    grid = np.linspace(t_stats["mn"], s_stats["mx"], GRID_POINTS) if hib else \
        np.linspace(s_stats["mn"], t_stats["mx"], GRID_POINTS)
    for _ in range(2):
        diff = _kde_on_grid(tc, tcnt, n_tail, t_stats["sd"] or 0.0, grid) - \
            _kde_on_grid(sc, scnt, n, s_stats["sd"] or 0.0, grid)
        best = int(np.argmax(diff) if hib else np.argmin(diff))
        found = float(grid[best])
        grid = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, GRID_POINTS - 1)], GRID_POINTS)
    return found
