"""Readers that turn stored tables into the document model
``(id BIGINT, text STRING, language STRING, source STRING[, url STRING])``.

Only the needed columns are selected, so parquet scans read just those
columns (and any later filter is pushed into the scan).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .langs import LANGUAGES


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread_small_input(df: DataFrame) -> DataFrame:
    """Spread a table whose scan has fewer tasks than there are cores.

    A small table stored as one row group is scanned -- and all per-document
    work fused into that scan runs -- in ONE task.  Such a table is dealt out
    round-robin (a deterministic repartition of less than one split a core).
    Larger inputs, also those in a few huge files, have more splits than cores
    and are left exactly as scanned."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() < par:
        return df.repartition(par)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small_input(spark.read.parquet(table_path(sf_dir, name)))


def bcp47_to_iso3(col: Column) -> Column:
    """Map a two-letter tag to the registry's iso3 id (literal map, no join);
    unknown tags pass through unchanged."""
    pairs = []
    for row in LANGUAGES:
        pairs += [F.lit(row[2]), F.lit(row[0])]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), col)


def documents_model(df: DataFrame, with_n_chars: bool = False) -> DataFrame:
    """Raw ``documents`` columns -> ``(id, text, language, source)``."""
    cols = [F.col("doc_id").alias("id"), F.col("text"), bcp47_to_iso3(F.col("lang")).alias("language"),
            F.col("source")]
    if with_n_chars:
        cols.append(F.col("n_chars"))
    return df.select(*cols)


def read_documents(spark: SparkSession, sf_dir: str, with_n_chars: bool = False) -> DataFrame:
    """The ``documents`` table in the document model."""
    return documents_model(read_table(spark, sf_dir, "documents"), with_n_chars)


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("source"))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html")


# SQL spelling of the same mapping for DuckDB oracles.
def sql_iso3(col_sql: str) -> str:
    whens = " ".join(f"WHEN '{r[2]}' THEN '{r[0]}'" for r in LANGUAGES)
    return f"(CASE {col_sql} {whens} ELSE {col_sql} END)"


SQL_DOCUMENTS = (f"(SELECT doc_id AS id, text, {sql_iso3('lang')} AS language, source "
                 f"FROM documents)")
