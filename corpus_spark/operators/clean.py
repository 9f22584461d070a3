"""Line-level cleaning ("pre-filter"): URL removal, script filter, bracket
clean-up, C4 line rules and removal of empty documents.

All of it is one projection of native expressions over the ``text`` column:
split into lines, ``transform``/``filter`` the line array, join again.  No
shuffle, no Python.  Patterns are string literals so the JVM compiles each of
them once per task.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE_RUN, is_blank, splitlines, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Characters accepted next to a script: marks, punctuation, symbols, numbers,
# separators and "other" (control/format) characters.
ACCEPTED_CLASSES = r"\p{M}\p{P}\p{S}\p{N}\p{Z}\p{C}"
# A bracketed span that contains no letter.
BRACKETS = r"[\(\[\{][^\p{L}]+[\)\]\}]"
# C4 line rules: a line must end in terminal punctuation (Po or Pf), contain
# at least 5 characters that are neither word characters nor white space, and
# must not contain "lorem ipsum".
C4_TERMINAL = r"[\p{Po}\p{Pf}]\z"
C4_SYMBOL = r"(?U)[^\w\s]"
C4_MIN_SYMBOLS = 5
LOREM = "lorem ipsum"

# Script names: ISO 15924 code -> Java script name (Java accepts both the
# 4-letter code and the long name after "Is").
def script_class(scripts: Sequence[str]) -> str:
    return "".join(rf"\p{{Is{s}}}" for s in scripts)


def script_filter_line(line: Column, scripts: Sequence[str]) -> Column:
    """Keep the maximal runs of [script + accepted] characters that contain at
    least one script character, concatenated.  Equal to ``findall`` of
    ``[acc]*[scr]+[acc]*`` joined, but linear in the line length."""
    scr = script_class(scripts)
    runs = F.regexp_extract_all(line, F.lit(f"[{ACCEPTED_CLASSES}{scr}]+"), 0)
    return F.array_join(F.filter(runs, lambda r: r.rlike(f"[{scr}]")), "")


def bracket_cleanup(line: Column) -> Column:
    """Letter-free bracketed spans become a space; white-space runs collapse."""
    return F.regexp_replace(F.regexp_replace(line, BRACKETS, " "), WHITESPACE_RUN, " ")


def c4_line_ok(line: Column) -> Column:
    return (~is_blank(line)
            & line.rlike(C4_TERMINAL)
            & (F.regexp_count(line, F.lit(C4_SYMBOL)) >= C4_MIN_SYMBOLS)
            & ~F.lower(line).contains(LOREM))


def clean_lines(text: Column, scripts: Sequence[str] | None = None, c4: bool = False,
                line_filter=None) -> Column:
    """The per-document line pipeline as one Column expression."""
    lines = F.transform(splitlines(text), lambda ln: strip(ln))
    lines = F.filter(lines, lambda ln: ln != "")
    if scripts:
        lines = F.transform(lines, lambda ln: bracket_cleanup(script_filter_line(ln, scripts)))
        lines = F.filter(lines, lambda ln: ~is_blank(ln))
    if line_filter is not None:
        lines = F.filter(lines, line_filter)
    if c4:
        lines = F.filter(lines, c4_line_ok)
    return F.array_join(lines, "\n")


def pre_filter(df: DataFrame, scripts: Sequence[str] | None = None, c4: bool = False,
               urls_to_remove: DataFrame | Iterable[str] | None = None,
               line_filter=None, warn_fraction: float | None = None,
               text_col: str = "text", url_col: str = "url") -> DataFrame:
    """Clean every document line by line and drop documents left blank.

    ``scripts``: ISO 15924 script codes to keep (e.g. ``["Latn"]``).
    ``c4``: apply the C4 line rules.  ``urls_to_remove``: a DataFrame with a
    ``url`` column or an iterable of URLs; matching documents are removed
    (left anti join; a Python list is turned into a small DataFrame).
    ``line_filter``: an extra ``Column -> Column`` predicate on lines.
    ``warn_fraction``: add ``removed_frac`` and keep all documents, also those
    left blank, for :func:`flag_removed_chars`; drop blank ones afterwards with
    :func:`drop_empty_docs`.
    """
    if not (scripts or c4 or line_filter is not None or urls_to_remove is not None):
        raise ValueError("pre_filter: no filter is switched on.")
    if urls_to_remove is not None:
        df = remove_urls(df, urls_to_remove, url_col)
    cleaned = clean_lines(F.col(text_col), scripts, c4, line_filter)
    if warn_fraction is not None:
        return _with_removed_frac(df, text_col, cleaned)
    return drop_empty_docs(_materialize(df, text_col, cleaned), text_col)


def remove_urls(df: DataFrame, urls_to_remove: DataFrame | Iterable[str], url_col: str = "url") -> DataFrame:
    """Documents whose URL is not in the list; a table without URLs is an error."""
    if url_col not in df.columns:
        raise ValueError(f"urls_to_remove needs a `{url_col}` column in the table.")
    if not isinstance(urls_to_remove, DataFrame):
        urls_to_remove = df.sparkSession.createDataFrame([(u,) for u in urls_to_remove], "url string")
    # anti join: the URL list is typically small and gets broadcast by AQE;
    # a large one is shuffled like any other join side.
    return df.join(urls_to_remove.select(F.col("url").alias(url_col)).distinct(), on=url_col, how="left_anti")


def _with_removed_frac(df: DataFrame, text_col: str, cleaned: Column) -> DataFrame:
    """Cleaned text and the share of characters that cleaning removed."""
    before, after = F.length(F.col(text_col)), F.length("__clean")
    others = [c for c in df.columns if c != text_col]
    both = df.select(*others, text_col, F.explode(F.array(cleaned)).alias("__clean"))
    frac = F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))
    return both.withColumn("removed_frac", frac).drop(text_col).withColumnRenamed("__clean", text_col) \
        .select(*df.columns, "removed_frac")


def _materialize(df: DataFrame, col: str, expr: Column) -> DataFrame:
    """Replace ``col`` by ``expr`` behind a Generate.  A later filter on the
    column is then not pushed below the projection with the expression
    inlined, so the line pipeline runs once per document, not once per use."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(F.array(expr)).alias(col)).select(*df.columns)


def flag_removed_chars(df: DataFrame, warn_fraction: float) -> DataFrame:
    """Rows whose cleaning removed more than ``warn_fraction`` of the characters."""
    return df.filter(F.col("removed_frac") > F.lit(warn_fraction))


def apply_pre_filter(df: DataFrame, lang_scripts: dict[str, Sequence[str]] | None = None, c4: bool = False,
                     urls_to_remove: DataFrame | Iterable[str] | None = None, profiles: DataFrame | None = None,
                     id_col: str = "id", language_col: str = "language", text_col: str = "text") -> DataFrame:
    """All pre-filter steps that are asked for, in their fixed order: URLs,
    line splitting with the scripts of the document's language, language id
    (lines in the document's own language by ``profiles``), C4 line rules,
    blank documents.  Without language id it is one projection."""
    if urls_to_remove is not None:
        df = remove_urls(df, urls_to_remove)
    if profiles is None:
        return pre_filter_by_language(df, lang_scripts or {}, c4, language_col, text_col, split_lines=True)
    from .lm import lang_id_filter
    df = pre_filter_by_language(df, lang_scripts or {}, False, language_col, text_col, split_lines=True)
    df = lang_id_filter(df, profiles, None, id_col, text_col, language_col)
    return pre_filter(df, c4=True, text_col=text_col) if c4 else df


def drop_empty_docs(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(text_col)))


def pre_filter_by_language(df: DataFrame, lang_scripts: dict[str, Sequence[str]], c4: bool = False,
                           language_col: str = "language", text_col: str = "text",
                           split_lines: bool = False) -> DataFrame:
    """Pre-filter a multilingual table with each language's own scripts.
    ``split_lines``: split and strip the lines of all other documents too.

    One literal pattern per distinct *script set* (not per language) inside a
    ``CASE`` so every pattern is compiled once; languages without a script set
    keep their lines unchanged apart from stripping/C4.
    """
    by_set: dict[tuple, list[str]] = {}
    for lang, scr in lang_scripts.items():
        by_set.setdefault(tuple(scr), []).append(lang)
    text = F.col(text_col)
    expr = None
    for scr, langs in by_set.items():
        branch = clean_lines(text, list(scr), c4)
        cond = F.col(language_col).isin(*langs)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    default = clean_lines(text, None, c4) if c4 or split_lines else text
    expr = default if expr is None else expr.otherwise(default)
    return drop_empty_docs(_materialize(df, text_col, expr), text_col)
