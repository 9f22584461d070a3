"""Attach quality signals to a document table (one projection, no shuffle)."""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import TOKEN_FORMS, get_metric, shared_inputs
from ..functions.text import tokenize


def with_tokens(df: DataFrame, text_col: str = "text",
                tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add a ``tokens`` column once.

    The array is produced behind a Generate (``explode`` of a one-element
    array): Catalyst does not push later filters on metric columns below a
    Generate, so the regex tokenizer runs exactly once per document instead of
    once per predicate that references it.
    """
    if "tokens" in df.columns:
        return df
    tok = (tokenizer or tokenize)(F.col(text_col))
    return df.select("*", F.explode(F.array(tok)).alias("tokens"))


def compute_metrics(df: DataFrame, metrics: Iterable[str], text_col: str = "text",
                    tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add one column per metric name; metrics already present are skipped.
    With a ``tokenizer``, or a ``tokens`` column in the table, all signals on
    words count those tokens."""
    todo = [m for m in dict.fromkeys(metrics) if m not in df.columns]
    if not todo:
        return df
    ms = [get_metric(m) for m in todo]
    own = tokenizer is not None or "tokens" in df.columns
    if any(m.needs_tokens for m in ms) or own:
        df = with_tokens(df, text_col, tokenizer)
    t = F.col(text_col)
    k = F.col("tokens") if "tokens" in df.columns else None
    # Inputs several metrics share (token and line counts) are computed once
    # in a projection below the Generate.
    base = df.select("*", *shared_inputs(t, k))
    # Metrics are generated as one struct behind a Generate: filters on them
    # (thresholds) cannot be pushed below it, so each metric is evaluated once.
    fns = {m.name: TOKEN_FORMS.get(m.name, m.fn) if own else m.fn for m in ms}
    packed = F.struct(*[fns[m.name](t, k).alias(m.name) for m in ms])
    return (base.select("*", F.explode(F.array(packed)).alias("__metrics"))
            .select(*df.columns, *[F.col("__metrics")[m.name].alias(m.name) for m in ms]))


def drop_metric_columns(df: DataFrame, metrics: Iterable[str], keep_columns: bool = False) -> DataFrame:
    if keep_columns:
        return df
    drop = [c for c in list(metrics) + ["tokens"] if c in df.columns]
    return df.drop(*drop)
