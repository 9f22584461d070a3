"""Keep the better (or worse) half of a corpus by one or several metrics.

Split methods: ``mean_cutoff``, ``median_cutoff``, ``balanced_docs``,
``balanced_chars`` and ``elbow``.  Partition 1 is the low side, partition 2
the high side; ``quality=True`` returns the high side for higher-is-better
metrics and the low side otherwise (``quality=False`` flips it).  Several
metrics are either combined into one min-max-normalised score or joined by
``intersection``/``union`` of the per-metric selections.

Global order statistics (median, the balanced cuts) come from the exact
distributed cut search in :mod:`.cutpoint`; the mean is one aggregate.
Nothing here sorts the whole table in one task.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import get_metric
from .cutpoint import attach_low_flag, find_cuts
from .metrics import compute_metrics, drop_metric_columns

METHODS = ("mean_cutoff", "median_cutoff", "balanced_docs", "balanced_chars", "elbow")


def _value_at_rank(keys: DataFrame, metric: str, id_col: str, rank: int) -> float | None:
    """Metric value of the row at 0-based position ``rank`` in (metric, id) order."""
    cut = find_cuts(keys, metric, id_col, None, rank)[()]
    return None if cut is None or cut[1] else float(cut[0])


def median_value(df: DataFrame, metric: str, id_col: str = "id") -> float | None:
    """Exact median (mean of the two middle values for an even count) of the
    non-NULL values, by two rank look-ups instead of collecting the values."""
    keys = df.select(metric, id_col).filter(F.col(metric).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keys.count()
        if n == 0:
            return None
        a = _value_at_rank(keys, metric, id_col, (n - 1) // 2)
        b = a if n % 2 == 1 else _value_at_rank(keys, metric, id_col, n // 2)
        return (a + b) / 2.0
    finally:
        keys.unpersist()


def _chars(text_col: str, chars_col: str | None) -> Column:
    """Characters of a document: a column that has them, or from its text."""
    return (F.col(chars_col) if chars_col else F.length(F.col(text_col))).cast("long")


def _high_flag_by(df: DataFrame, metric: str, split_method: str, by: list[str], id_col: str,
                  text_col: str, flag: str, chars_col: str | None = None) -> DataFrame:
    """Per-group version of :func:`high_flag` (mean and balanced methods)."""
    m = F.col(metric)
    if split_method == "mean_cutoff":
        means = df.groupBy(*by).agg(F.avg(m.cast("double")).alias("__mean"))
        # one row per group; AQE broadcasts it when it is small
        j = df.join(means, on=by, how="left")
        return j.withColumn(flag, m >= F.col("__mean")).drop("__mean")
    if split_method in ("balanced_docs", "balanced_chars"):
        src, weight = df, None
        if split_method == "balanced_chars":
            src, weight = df.withColumn("__len", _chars(text_col, chars_col)), "__len"
        keys = src.select(*by, metric, id_col, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tot = F.sum(weight) if weight else F.count(F.lit(1))
            budgets = {tuple(r[g] for g in by): (r["t"] or 0) // 2
                       for r in keys.groupBy(*by).agg(tot.alias("t")).collect()}
            cuts = find_cuts(keys, metric, id_col, weight, budgets, by)
        finally:
            keys.unpersist()
        out = attach_low_flag(df, metric, id_col, cuts, by, "__low")
        return out.withColumn(flag, ~F.col("__low")).drop("__low")
    raise ValueError("by= supports mean_cutoff, balanced_docs and balanced_chars")


def high_flag(df: DataFrame, metric: str, split_method: str, id_col: str = "id",
              text_col: str = "text", flag: str = "__high", by: list[str] | None = None,
              chars_col: str | None = None) -> DataFrame:
    """Add a boolean ``flag``: True for partition 2 (the high side), False for
    partition 1.  Rows with an undefined (NULL) metric get NULL for the
    cutoff methods and sort last for the balanced ones.  ``by`` splits each
    group (e.g. language) separately."""
    if by:
        return _high_flag_by(df, metric, split_method, list(by), id_col, text_col, flag, chars_col)
    m = F.col(metric)
    if split_method == "mean_cutoff":
        mean = df.agg(F.avg(m.cast("double"))).first()[0]
        return df.withColumn(flag, m >= F.lit(mean) if mean is not None else F.lit(None).cast("boolean"))
    if split_method == "median_cutoff":
        med = median_value(df, metric, id_col)
        return df.withColumn(flag, m >= F.lit(med) if med is not None else F.lit(None).cast("boolean"))
    if split_method in ("balanced_docs", "balanced_chars"):
        weight = None
        src = df
        if split_method == "balanced_chars":
            src = df.withColumn("__len", _chars(text_col, chars_col))
            weight = "__len"
        keys = src.select(metric, id_col, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if weight:
                total = keys.agg(F.sum(weight)).first()[0] or 0
            else:
                total = keys.count()
            budget = total // 2
            cuts = find_cuts(keys, metric, id_col, weight, budget)
        finally:
            keys.unpersist()
        out = attach_low_flag(df, metric, id_col, cuts, None, "__low")
        return out.withColumn(flag, ~F.col("__low")).drop("__low")
    if split_method == "elbow":
        from .curves import elbow_high_flag
        return elbow_high_flag(df, metric, id_col, flag)
    raise ValueError(f"split_method must be one of {', '.join(METHODS)}, not {split_method!r}")


def select_flag(df: DataFrame, metric: str, split_method: str, quality: bool = True,
                id_col: str = "id", text_col: str = "text", flag: str = "__keep",
                by: list[str] | None = None, chars_col: str | None = None) -> DataFrame:
    """Flag the rows of the wanted side."""
    hib = True if metric == "combined_metrics" else get_metric(metric).higher_is_better
    out = high_flag(df, metric, split_method, id_col, text_col, "__high", by, chars_col)
    want_high = (hib and quality) or (not hib and not quality)
    keep = F.col("__high") if want_high else ~F.col("__high")
    if split_method == "elbow":
        # no knee: both partitions hold every row; a row without a metric is in neither
        keep = F.col(metric).isNotNull() & F.coalesce(keep, F.lit(True))
    return out.withColumn(flag, F.coalesce(keep, F.lit(False))).drop("__high")


def combined_score(df: DataFrame, metrics: Sequence[str], out: str = "combined_metrics") -> DataFrame:
    """Sum of min-max normalised metrics (direction ignored, like the reference).
    A constant metric contributes 0 instead of NaN."""
    aggs = []
    for mname in metrics:
        aggs += [F.min(F.col(mname).cast("double")).alias(f"mn_{mname}"),
                 F.max(F.col(mname).cast("double")).alias(f"mx_{mname}")]
    mm = df.agg(*aggs).first()
    score = F.lit(0.0)
    for mname in metrics:
        lo, hi = mm[f"mn_{mname}"], mm[f"mx_{mname}"]
        if lo is None or hi is None or hi == lo:
            part = F.lit(0.0)
        else:
            part = (F.col(mname).cast("double") - F.lit(lo)) / F.lit(hi - lo)
        score = score + part
    return df.withColumn(out, score)


def partition(df: DataFrame, metrics: str | Sequence[str], split_method: str, quality: bool = True,
              join_partitions_by: str | None = None, keep_columns: bool = False,
              id_col: str = "id", text_col: str = "text",
              tokenizer: Callable[[Column], Column] | None = None, by: list[str] | None = None,
              chars_col: str | None = None) -> DataFrame:
    """Return the selected half of ``df`` (see module docstring).  ``by``
    (e.g. ``["language"]``) splits every group separately instead of the
    combined table.  ``chars_col``: a column with the characters of each
    document, for tables that do not carry the text."""
    if df.isStreaming:
        raise ValueError("partition() needs the whole table; a stream has no halves")
    if split_method not in METHODS:
        raise ValueError(f"split_method must be one of {', '.join(METHODS)}, not {split_method!r}")
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    df = compute_metrics(df, metrics, text_col, tokenizer)
    if join_partitions_by:
        if join_partitions_by not in ("intersection", "union"):
            raise ValueError("join_partitions_by must be None, 'intersection' or 'union'")
        flags = []
        for i, mname in enumerate(metrics):
            df = select_flag(df, mname, split_method, quality, id_col, text_col, f"__keep{i}", by, chars_col)
            flags.append(F.col(f"__keep{i}"))
        cond = flags[0]
        for f in flags[1:]:
            cond = (cond & f) if join_partitions_by == "intersection" else (cond | f)
        out = df.filter(cond).drop(*[f"__keep{i}" for i in range(len(metrics))])
    elif len(metrics) > 1:
        df = combined_score(df, metrics)
        out = select_flag(df, "combined_metrics", split_method, quality, id_col, text_col, "__keep", by, chars_col) \
            .filter("__keep").drop("__keep", "combined_metrics")
    else:
        out = select_flag(df, metrics[0], split_method, quality, id_col, text_col, "__keep", by, chars_col) \
            .filter("__keep").drop("__keep")
    return drop_metric_columns(out, metrics, keep_columns)
