"""Queries for tokenisation, line cleaning and quality signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals
from ..functions.text import char_ngrams, splitlines, strip, tokenize, word_ngrams
from ..operators import clean
from ..operators.metrics import compute_metrics
from ..sources.langs import scripts_for
from ..sources.tables import read_documents, read_pages
from . import sqlfrag as S
from .registry import register

DOCS = S.DOCS
TOKD = f"(SELECT *, {S.tok('text')} AS tokens FROM {DOCS})"


def docs(spark, sf):
    return read_documents(spark, sf)


@register("tokenize", f"""
SELECT id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens_str FROM {TOKD}""")
def q_tokenize(spark, sf):
    k = tokenize("text")
    return docs(spark, sf).select("id", F.size(k).cast("long").alias("n_tokens"),
                                  F.array_join(k, " ").alias("tokens_str"))


@register("word_ngrams", f"""
SELECT id, len({S.ngrams('tokens', 3)})::BIGINT AS n_trigrams,
       md5(array_to_string({S.ngrams('tokens', 3)}, '|')) AS trigrams_md5 FROM {TOKD}""")
def q_word_ngrams(spark, sf):
    g = word_ngrams(tokenize("text"), 3)
    return docs(spark, sf).select("id", F.size(g).cast("long").alias("n_trigrams"),
                                  F.md5(F.array_join(g, "|")).alias("trigrams_md5"))


@register("char_ngrams", f"""
SELECT id, len({S.ngrams(S.chars('text'), 3)})::BIGINT AS n_char_trigrams,
       len(list_distinct({S.ngrams(S.chars('text'), 3)}))::BIGINT AS distinct_char_trigrams FROM {DOCS}""")
def q_char_ngrams(spark, sf):
    g = char_ngrams(F.col("text"), 3)
    return docs(spark, sf).select("id", F.size(g).cast("long").alias("n_char_trigrams"),
                                  F.size(F.array_distinct(g)).cast("long").alias("distinct_char_trigrams"))


@register("split_clean_lines", f"""
SELECT id, {S.clean_lines('text')} AS text FROM {DOCS}""")
def q_split_clean_lines(spark, sf):
    return docs(spark, sf).select("id", clean.clean_lines(F.col("text")).alias("text"))


@register("script_filter", f"""
SELECT id, {S.clean_lines('text', ['Latn'], brackets=False)} AS text FROM {DOCS}""")
def q_script_filter(spark, sf):
    lines = F.filter(F.transform(splitlines(F.col("text")), lambda ln: strip(ln)), lambda ln: ln != "")
    lines = F.transform(lines, lambda ln: clean.script_filter_line(ln, ["Latn"]))
    lines = F.filter(lines, lambda ln: strip(ln) != "")
    return docs(spark, sf).select("id", F.array_join(lines, "\n").alias("text"))


@register("bracket_cleanup", f"""
SELECT id, {S.clean_lines('text', ['Latn'])} AS text FROM {DOCS}""")
def q_bracket_cleanup(spark, sf):
    return docs(spark, sf).select("id", clean.clean_lines(F.col("text"), ["Latn"]).alias("text"))


@register("c4_line_filter", f"""
SELECT id, {S.clean_lines('text', None, c4=True)} AS text FROM {DOCS}""")
def q_c4(spark, sf):
    return docs(spark, sf).select("id", clean.clean_lines(F.col("text"), None, c4=True).alias("text"))


@register("drop_empty_docs", f"""
SELECT id, text FROM (SELECT id, {S.clean_lines('text', None, c4=True)} AS text FROM {DOCS})
WHERE {S.strip('text')} <> ''""")
def q_drop_empty(spark, sf):
    d = docs(spark, sf).select("id", clean.clean_lines(F.col("text"), None, c4=True).alias("text"))
    return clean.drop_empty_docs(d)


@register("flag_removed_chars", f"""
SELECT id, round(removed_frac, 6) AS removed_frac FROM (
  SELECT id, (length(text) - length({S.clean_lines('text', ['Latn'], c4=True)}))::DOUBLE / length(text) AS removed_frac,
         {S.clean_lines('text', ['Latn'], c4=True)} AS cleaned
  FROM {DOCS} WHERE length(text) > 0)
WHERE removed_frac > 0.5""")
def q_flag_removed(spark, sf):
    d = clean.pre_filter(docs(spark, sf), scripts=["Latn"], c4=True, warn_fraction=0.5)
    return clean.flag_removed_chars(d, 0.5).select("id", F.round("removed_frac", 6).alias("removed_frac"))


@register("pre_filter", f"""
SELECT id, text, language, source FROM (
  SELECT id, {S.clean_lines('text', ['Latn'], c4=True)} AS text, language, source FROM {DOCS})
WHERE {S.strip('text')} <> ''""")
def q_pre_filter(spark, sf):
    return clean.pre_filter(docs(spark, sf), scripts=["Latn"], c4=True)


@register("pre_filter_multilingual", f"""
SELECT id, text, language FROM (
  SELECT id, CASE WHEN language IN ('eng', 'fra', 'deu', 'spa') THEN {S.clean_lines('text', ['Latn'])}
             ELSE text END AS text, language FROM {DOCS})
WHERE {S.strip('text')} <> ''""")
def q_pre_filter_multi(spark, sf):
    d = docs(spark, sf)
    return clean.pre_filter_by_language(d, scripts_for(["eng", "fra", "deu", "spa"])).select("id", "text", "language")


# URL block list derived from the pages table itself: every mobile mirror.
@register("remove_urls", """
SELECT page_id AS id, url FROM pages
WHERE url NOT IN (SELECT url FROM pages WHERE regexp_matches(url, '^https?://m[.]'))""")
def q_remove_urls(spark, sf):
    pages = read_pages(spark, sf).select("id", "url", F.col("html").alias("text"))
    block = pages.filter(F.col("url").rlike(r"^https?://m[.]")).select("url")
    return clean.pre_filter(pages, urls_to_remove=block).select("id", "url")


# --- one query per quality signal --------------------------------------------
def _metric_query(name):
    def q(spark, sf):
        d = compute_metrics(docs(spark, sf), [name])
        c = F.round(F.col(name), 6) if name in S.FLOAT_METRICS else F.col(name)
        return d.select("id", c.alias(name))
    q.__name__ = f"q_metric_{name}"
    return q


_METRIC_NAMES = [n for n in signals.REGISTRY]
for _name in _METRIC_NAMES:
    register(_name, f"SELECT id, {S.metric_out(_name)} FROM {TOKD}")(_metric_query(_name))


@register("compute_metrics", f"""
SELECT id, {', '.join(S.metric_out(n) for n in _METRIC_NAMES)} FROM {TOKD}""")
def q_compute_metrics(spark, sf):
    d = compute_metrics(docs(spark, sf), _METRIC_NAMES)
    return d.select("id", *[(F.round(n, 6) if n in S.FLOAT_METRICS else F.col(n)).alias(n) for n in _METRIC_NAMES])


# A user metric: fraction of digit characters, lower is better.
def _frac_digits(t, k):
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(r"\p{Nd}")) / F.length(t))


if "frac_digit_chars" not in signals.REGISTRY:
    signals.register_metric("frac_digit_chars", _frac_digits, higher_is_better=False, needs_tokens=False)


@register("register_metric", f"""
SELECT id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / length(text) END, 6)
       AS frac_digit_chars FROM {DOCS}
WHERE coalesce(len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / nullif(length(text), 0) <= 0.01, false)""")
def q_register_metric(spark, sf):
    from ..operators.threshold import apply_threshold
    d = apply_threshold(docs(spark, sf), {"frac_digit_chars": 0.01}, keep_columns=True)
    return d.select("id", F.round("frac_digit_chars", 6).alias("frac_digit_chars"))
