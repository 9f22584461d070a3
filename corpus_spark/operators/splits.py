"""Reproducible train/test splits and corpus set operations."""

from __future__ import annotations

import math
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .cutpoint import attach_low_flag, find_cuts
from .rowindex import group_counts


def seeded_key(id_col: str, seed: int):
    """Reproducible pseudo-random order key of a row: the first 13 hex digits
    (52 bits, exact as a double) of md5("<seed>:<id>")."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 13),
                  16, 10).cast("long")


def _order_key(id_col: str, shuffle: bool, seed: int):
    if shuffle:
        return seeded_key(id_col, seed).cast("double")
    return F.col(id_col).cast("double")


def train_test_split(df: DataFrame, test_size: float = 0.1, shuffle: bool = True, seed: int = 42,
                     id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """Add ``split`` = train/test with exact sizes: test = ceil(test_size * n)
    (per group when ``by`` is given).  Shuffled order is a seeded hash of the
    id (reproducible, independent of partitioning); unshuffled, the last rows
    by id are the test rows.  Replaces any existing ``split`` column."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1).")
    by = list(by or [])
    base = df.drop("split") if "split" in df.columns else df
    keyed = base.withColumn("__k", _order_key(id_col, shuffle, seed))
    ensure_checkpoint_dir(df.sparkSession)
    # ids and hashes are written once; the search below reads them several times
    keys = keyed.select(*by, "__k", id_col).checkpoint()
    counts = group_counts(keys, by) if by else {(): keys.count()}
    n_test = {g: math.ceil(test_size * n) for g, n in counts.items()}
    if shuffle:
        # test = the first n_test rows in (hash, id) order
        budgets, test_side_low = n_test, True
    else:
        # test = the last n_test rows by id, so train = the first n - n_test
        budgets, test_side_low = {g: counts[g] - n_test[g] for g in counts}, False
    cuts = find_cuts(keys, "__k", id_col, None, budgets if by else budgets[()], by)
    flagged = attach_low_flag(keyed, "__k", id_col, cuts, by, "__low")
    is_test = F.col("__low") if test_side_low else ~F.col("__low")
    return flagged.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("__low", "__k")


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; an absent split is an error (one tiny aggregate)."""
    if "split" not in df.columns:
        raise ValueError("Table has no `split` column.")
    out = df.filter(F.col("split") == split)
    if out.limit(1).count() == 0:
        raise ValueError(f"Split not found: {split}")
    return out


def merge_test_into_train(df: DataFrame) -> DataFrame:
    """Concatenate the test split into train (before filtering/partitioning)."""
    return df.withColumn("split", F.when(F.col("split") == "test", F.lit("train")).otherwise(F.col("split")))


def concat_splits(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def from_corpora(corpora: Mapping[str, DataFrame], language_col: str = "language") -> DataFrame:
    """Combine monolingual corpora into one table with a ``language`` column."""
    if not corpora:
        raise ValueError("No corpora given.")
    parts = [d.withColumn(language_col, F.lit(lang)) for lang, d in corpora.items()]
    return concat_splits(*parts)


def add_language(df: DataFrame, corpus: DataFrame, language: str, language_col: str = "language") -> DataFrame:
    """Add a corpus for a new language; an existing language is an error."""
    exists = df.filter(F.col(language_col) == language).limit(1).count() > 0
    if exists:
        raise ValueError(f"Language already present: {language}")
    return df.unionByName(corpus.withColumn(language_col, F.lit(language)), allowMissingColumns=True)


def remove_language(df: DataFrame, language: str, language_col: str = "language") -> DataFrame:
    """Drop one language; an unknown language is an error; an empty result is fine."""
    if df.filter(F.col(language_col) == language).limit(1).count() == 0:
        raise ValueError(f"Language not found: {language}")
    return df.filter(F.col(language_col) != language)
