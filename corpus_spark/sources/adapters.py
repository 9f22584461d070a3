"""Source adapters: turn each raw source table into the document model and
combine several sources of one language.

Each adapter is a pure DataFrame -> DataFrame projection (no shuffle); the
download/transport part of the reference (hub access) is not rebuilt --
sources are whatever tables the caller reads (parquet, JSON, ...).
"""

from __future__ import annotations

import logging
from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langs import KNOWN_SOURCES, lookup

log = logging.getLogger(__name__)


def adapt_wiki(df: DataFrame) -> DataFrame:
    """Wikipedia dump rows ``(id, url, title, text)`` -> ``(url, text)``."""
    return df.drop("title", "id")


def adapt_c4(df: DataFrame) -> DataFrame:
    """mC4 rows ``(text, timestamp, url)`` -> ``(text, url)``."""
    return df.drop("timestamp")


def adapt_parallel_bible(df: DataFrame, lang: str, pivot: str = "eng") -> DataFrame:
    """Parallel verses with one column per language -> that language's column as ``text``."""
    if lang not in df.columns:
        raise ValueError(f"Parallel table has no column for {lang}")
    return df.select(F.col(lang).alias("text"))


def adapt_translation_pairs(df: DataFrame, lang: str, script: str | None = None) -> DataFrame:
    """Translation pairs ``translation MAP<tag, text>`` (tags like ``hau_Latn``):
    from every pair the sides in the language, in any of its scripts (or in
    ``script``), as ``text``.  One scan over all pairs."""
    info = lookup(lang)
    tags = [f"{info['id']}_{s}" for s in ([script] if script else info["scripts"])]
    sides = F.array(*[F.try_element_at("translation", F.lit(t)) for t in tags])
    return df.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("text"))


#: Subset names that do not end in the first script of the language.
SUBSETS = {"jpn": "jpn_Jpan"}


def fineweb_subset(lang: str) -> str:
    """Subset name of a language in the multilingual web crawl: ``iso3_Script``."""
    info = lookup(lang)
    return SUBSETS.get(info["id"], f"{info['id']}_{info['scripts'][0]}")


def adapt_fineweb(df: DataFrame, lang: str, subset_col: str = "subset", subsets: DataFrame | None = None) -> DataFrame:
    """Rows of the language's subset, keeping only ``text``.  ``subsets``: a
    table (language, subset) to take the names from, one row or several for a
    language; it is a dimension with as many rows as the crawl has subsets."""
    if subsets is None:
        return df.filter(F.col(subset_col) == F.lit(fineweb_subset(lang))).select("text")
    names = [r["subset"] for r in subsets.filter(F.col("language") == lookup(lang)["id"]).select("subset").distinct().collect()]
    if not names:
        raise ValueError(f"The subset table has no row for {lang}")
    return df.filter(F.col(subset_col).isin(*names)).select("text")


ADAPTERS: dict[str, Callable] = {
    "wiki": lambda df, lang: adapt_wiki(df),
    "mc4": lambda df, lang: adapt_c4(df),
    "bible": lambda df, lang: adapt_parallel_bible(df, lang),
    "nllb": lambda df, lang: adapt_translation_pairs(df, lang),
    "fineweb": lambda df, lang: adapt_fineweb(df, lang),
}


def load_sources(raw: Mapping[str, DataFrame], lang: str) -> DataFrame:
    """Adapt and union several sources of one language, tagging ``source``.
    Unknown source names are warned about and skipped; a source the language
    does not have is skipped; no valid source is an error."""
    info = lookup(lang)
    parts = []
    for name, df in raw.items():
        if name not in KNOWN_SOURCES:
            log.warning("Unknown source %s skipped", name)
            continue
        if name not in info["sources"]:
            log.warning("Source %s not available for %s; skipped", name, lang)
            continue
        parts.append(ADAPTERS[name](df, lang).withColumn("source", F.lit(name)))
    if not parts:
        raise ValueError("No valid sources specified.")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def from_table(df: DataFrame, text_column: str = "text", source: str = "custom",
               language: str | None = None, language_column: str | None = None) -> DataFrame:
    """Wrap an existing table: the text column must exist; it is renamed to
    ``text``; a ``source`` literal is added; optionally a language literal or
    a renamed language column."""
    if text_column not in df.columns:
        raise ValueError(f"Text column `{text_column}` not found in table.")
    out = df.withColumnRenamed(text_column, "text") if text_column != "text" else df
    out = out.withColumn("source", F.lit(source))
    if language_column:
        if language_column not in df.columns:
            raise ValueError(f"Language column `{language_column}` not found in table.")
        out = out.withColumnRenamed(language_column, "language")
    elif language:
        out = out.withColumn("language", F.lit(language))
    return out
