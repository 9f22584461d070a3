"""Queries for splits, set operations, sampling and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, sampling, splits, stats
from ..sources.tables import read_benchmark, read_documents
from . import sqlfrag as S
from .registry import register

DOCS = S.DOCS


def docs(spark, sf):
    return read_documents(spark, sf)


def _key_sql(seed=42, col="id"):
    return f"('0x' || substr(md5('{seed}:' || {col}::VARCHAR), 1, 13))::BIGINT"


@register("train_test_split", f"""
SELECT id, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, row_number() OVER (ORDER BY {_key_sql()}::DOUBLE, id) AS rn, count(*) OVER () AS n FROM {DOCS})""")
def q_split(spark, sf):
    return splits.train_test_split(docs(spark, sf), 0.1, seed=42).select("id", "split")


@register("train_test_split_unshuffled", f"""
SELECT id, CASE WHEN rn > n - ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM {DOCS})""")
def q_split_unshuffled(spark, sf):
    return splits.train_test_split(docs(spark, sf), 0.2, shuffle=False).select("id", "split")


@register("train_test_split_multilingual", f"""
SELECT id, language, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY {_key_sql(7)}::DOUBLE, id) AS rn,
         count(*) OVER (PARTITION BY language) AS n FROM {DOCS})""")
def q_split_multi(spark, sf):
    return splits.train_test_split(docs(spark, sf), 0.1, seed=7, by=["language"]).select("id", "language", "split")


@register("select_split", f"""
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_key_sql()}::DOUBLE, id) AS rn, count(*) OVER () AS n
FROM {DOCS}) WHERE rn <= ceil(0.1 * n)""")
def q_select_split(spark, sf):
    return splits.select_split(splits.train_test_split(docs(spark, sf), 0.1, seed=42), "test").select("id")


@register("merge_test_then_threshold", f"""
SELECT id, 'train' AS split FROM (SELECT *, {S.tok('text')} AS tokens FROM {DOCS})
WHERE coalesce({S.metric_sql('length_words')} >= 100, false)""")
def q_merge_test(spark, sf):
    from ..operators.threshold import apply_threshold
    d = splits.merge_test_into_train(splits.train_test_split(docs(spark, sf), 0.1))
    return apply_threshold(d, {"length_words": 100}).select("id", "split")


@register("concat_splits", f"""
SELECT doc_id AS id, text, 'train' AS split FROM documents
UNION ALL SELECT item_id AS id, text, 'test' AS split FROM benchmark""")
def q_concat(spark, sf):
    tr = docs(spark, sf).select("id", "text", F.lit("train").alias("split"))
    te = read_benchmark(spark, sf).select("id", "text", F.lit("test").alias("split"))
    return splits.concat_splits(tr, te)


@register("add_language", f"""
SELECT id, language, source FROM {DOCS}
UNION ALL SELECT item_id AS id, 'hau' AS language, 'benchmark' AS source FROM benchmark""")
def q_add_language(spark, sf):
    d = docs(spark, sf).select("id", "language", "source")
    b = read_benchmark(spark, sf).select("id", "source")
    return splits.add_language(d, b, "hau").select("id", "language", "source")


@register("remove_language", f"SELECT id, language FROM {DOCS} WHERE language <> 'eng'")
def q_remove_language(spark, sf):
    return splits.remove_language(docs(spark, sf), "eng").select("id", "language")


@register("from_corpora", f"SELECT id, text, language FROM {DOCS}")
def q_from_corpora(spark, sf):
    d = docs(spark, sf)
    # one corpus for each language there is
    corpora = {r["language"]: d.filter(F.col("language").eqNullSafe(r["language"])).select("id", "text")
               for r in stats.distinct_languages(d).collect()}
    return splits.from_corpora(corpora).select("id", "text", "language")


@register("interleave_round_robin", """
WITH s AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
                  dense_rank() OVER (ORDER BY source) - 1 AS r FROM documents),
m AS (SELECT min(c) AS m, count(*) AS g FROM (SELECT source, count(*) AS c FROM documents GROUP BY source))
SELECT id, source, i * g + r AS t FROM s, m WHERE i < m""")
def q_round_robin(spark, sf):
    return sampling.interleave_round_robin(docs(spark, sf), "source").select("id", "source", "t")


@register("sample_first_exhausted", S.sample_sql(f"SELECT id, language FROM {DOCS}", S.COUNTS, "pow(w, 1.0 / 0.5)", "min"))
def q_sample_first(spark, sf):
    """Temperature-0.5 language sampling, stop at the first exhausted language."""
    return sampling.apply_language_sampling(docs(spark, sf), "temperature", 0.5, "first_exhausted") \
        .select("t", "id", "language")


@register("sample_all_exhausted", S.sample_sql(f"SELECT id, language FROM {DOCS}", S.COUNTS, "1.0", "max"))
def q_sample_all(spark, sf):
    """Uniform language sampling until every language was exhausted once."""
    return sampling.apply_language_sampling(docs(spark, sf), "uniform", 1.0, "all_exhausted") \
        .select("t", "id", "language")


@register("sample_with_raw_weights", S.sample_sql(
    f"SELECT id, language FROM {DOCS}", f"SELECT language, sum(length(text))::DOUBLE AS w FROM {DOCS} GROUP BY language",
    "1.0 / sqrt(w)", "min"))
def q_sample_raw(spark, sf):
    """Sampling with user weights (characters per language, computed on Spark)."""
    w = {r["language"]: r["chars"] for r in stats.corpus_stats(docs(spark, sf)).collect()}
    return sampling.apply_language_sampling(docs(spark, sf), "inverse_proportional_sqrt",
                                            interleaving_strategy="first_exhausted", raw_weights=w) \
        .select("t", "id", "language")


@register("batch_iterator", """
SELECT (rn - 1) // 100 AS batch_id, count(*)::BIGINT AS n_texts, md5(string_agg(text, chr(1) ORDER BY rn)) AS texts_md5
FROM (SELECT text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def q_batches(spark, sf):
    b = sampling.text_batches(docs(spark, sf), batch_size=100)
    return b.select("batch_id", F.size("texts").cast("long").alias("n_texts"),
                    F.md5(F.array_join("texts", "\u0001")).alias("texts_md5"))


# --- statistics ------------------------------------------------------------------
@register("deletion_report", f"""
WITH a AS (SELECT {S.clean_lines('text', None, c4=True)} AS text FROM {DOCS}),
a2 AS (SELECT text FROM a WHERE {S.strip('text')} <> ''),
b AS (SELECT count(*) AS d, sum(length(text)) AS c, sum(strlen(text)) AS y FROM documents),
f AS (SELECT count(*) AS d, coalesce(sum(length(text)), 0) AS c, coalesce(sum(strlen(text)), 0) AS y FROM a2)
SELECT (b.d - f.d)::BIGINT AS removed_docs, round((b.d - f.d) * 100.0 / b.d, 6) AS removed_docs_pct,
       (b.c - f.c)::BIGINT AS removed_chars, round((b.c - f.c) * 100.0 / b.c, 6) AS removed_chars_pct,
       (b.y - f.y)::BIGINT AS removed_bytes, round((b.y - f.y) * 100.0 / b.y, 6) AS removed_bytes_pct
FROM b, f""")
def q_deletion(spark, sf):
    before = docs(spark, sf)
    return stats.deletion_report(before, clean.pre_filter(before, c4=True))


@register("corpus_stats", f"""
SELECT language, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM {DOCS} GROUP BY language""")
def q_corpus_stats(spark, sf):
    return stats.corpus_stats(docs(spark, sf))


@register("distinct_languages", f"SELECT DISTINCT language FROM {DOCS}")
def q_distinct_languages(spark, sf):
    return stats.distinct_languages(docs(spark, sf))


_PROB_SQL = {
    "uniform": "1.0",
    "proportional": "w",
    "inverse_proportional": "1.0 / w",
    "inverse_proportional_sqrt": "1.0 / sqrt(w)",
    "temperature": "pow(w, 1.0 / 0.5)",
}
for _strategy, _expr in _PROB_SQL.items():
    def _mk(strategy):
        def q(spark, sf):
            w = stats.corpus_stats(docs(spark, sf)).select("language", F.col("docs").alias("weight"))
            p = stats.sampling_probs(w, strategy, temperature=0.5)
            return p.select("language", F.round("prob", 6).alias("prob"))
        return q
    _key = {"inverse_proportional": "inverse", "inverse_proportional_sqrt": "inverse_sqrt"}.get(_strategy, _strategy)
    register(f"sampling_probs_{_key}", f"""
SELECT language, round(({_expr}) / sum({_expr}) OVER (), 6) AS prob FROM (
  SELECT language, count(*)::DOUBLE AS w FROM {DOCS} GROUP BY language)""")(_mk(_strategy))


@register("predict_vocab_size", f"""
SELECT sum(length(text))::BIGINT AS chars,
       floor({stats.HEAPS_K} * pow(sum(length(text))::DOUBLE, {stats.HEAPS_B}) * {stats.HEAPS_RATIO})::BIGINT AS vocab_size
FROM documents""")
def q_vocab_size(spark, sf):
    return stats.predict_vocab_size(docs(spark, sf))


# --- distribution statistics and curves ----------------------------------------------
@register("ks_statistic", f"""
WITH u AS (SELECT length(text)::DOUBLE AS v, CASE WHEN language = 'eng' THEN 1.0 ELSE 0.0 END AS ca,
                  CASE WHEN language = 'eng' THEN 0.0 ELSE 1.0 END AS cb FROM {DOCS}),
per AS (SELECT v, sum(ca) AS ca, sum(cb) AS cb FROM u GROUP BY v),
c AS (SELECT sum(ca) OVER (ORDER BY v) / sum(ca) OVER () AS fa, sum(cb) OVER (ORDER BY v) / sum(cb) OVER () AS fb
      FROM per)
SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""")
def q_ks(spark, sf):
    from ..operators.curves import ks_statistic
    d = docs(spark, sf).withColumn("length_chars", F.length("text"))
    return ks_statistic(d.filter(F.col("language") == "eng"), d.filter(F.col("language") != "eng"), "length_chars")


@register("js_divergence", f"""
WITH x AS (SELECT length(text)::DOUBLE AS v, language = 'eng' AS e FROM {DOCS}),
r AS (SELECT e, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY e),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 100 ELSE 1.0 END AS wd FROM r),
h AS (SELECT e, b, count(*) / any_value(n * wd) AS d FROM (
  SELECT x.e, least(floor((v - lo) / wd), 99)::INTEGER AS b, n, wd FROM x JOIN w USING (e)) GROUP BY e, b),
p AS (SELECT b, coalesce(max(d) FILTER (WHERE e), 0.0) AS pa, coalesce(max(d) FILTER (WHERE NOT e), 0.0) AS pb FROM h GROUP BY b),
q AS (SELECT pa / sum(pa) OVER () AS a, pb / sum(pb) OVER () AS b, (pa + pb) / sum(pa + pb) OVER () AS m FROM p)
SELECT round(0.5 * (coalesce(sum(a * ln(a / m)) FILTER (WHERE a > 0), 0) + coalesce(sum(b * ln(b / m)) FILTER (WHERE b > 0), 0)), 6) AS js
FROM q""")
def q_js(spark, sf):
    """JS divergence of 100-bin length histograms: English vs. the rest."""
    from ..operators.curves import js_divergence
    d = docs(spark, sf).withColumn("length_chars", F.length("text"))
    js = js_divergence(d.filter(F.col("language") == "eng"), d.filter(F.col("language") != "eng"), "length_chars")
    return spark.createDataFrame([(round(js, 6),)], "js double")


@register("find_elbow", """
WITH c AS (SELECT len(string_split(text, chr(10)))::DOUBLE AS x, count(*)::DOUBLE AS y FROM documents GROUP BY 1),
s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, arg_min(y, x) AS yf, arg_max(y, x) AS yl FROM c),
n AS (SELECT c.x, (c.x - x0) / coalesce(nullif(x1 - x0, 0), 1) AS xn, (c.y - y0) / coalesce(nullif(y1 - y0, 0), 1) AS yn,
             (yf - y0) / coalesce(nullif(y1 - y0, 0), 1) AS a, (yl - y0) / coalesce(nullif(y1 - y0, 0), 1) AS b FROM c, s)
SELECT x AS elbow_x FROM n ORDER BY abs((b - a) * xn - yn + a) / sqrt((b - a) * (b - a) + 1) DESC, x LIMIT 1""")
def q_find_elbow(spark, sf):
    from ..operators.curves import find_elbow
    from ..functions.signals import char_count
    curve = docs(spark, sf).groupBy((char_count(F.col("text"), "\n") + 1).cast("double").alias("x")) \
        .agg(F.count(F.lit(1)).cast("double").alias("y"))
    return find_elbow(curve)


@register("representative_sample_size", f"""
WITH d AS (SELECT id, length(text)::DOUBLE AS v FROM {DOCS}), n AS (SELECT count(*) AS n FROM d),
sz AS (SELECT DISTINCT floor(pow(10.0, 1 + (log10(greatest(n, 10)) - 1) * i / 24.0))::BIGINT AS s
       FROM n, (SELECT unnest(range(25)) AS i)),
rk AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY
         ('0x' || substr(md5('rs0-' || r || ':' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE, id) AS k
       FROM d, (SELECT unnest(range(5)) AS r)),
c AS (SELECT r, s, v, count(*) AS a, count(*) FILTER (WHERE k <= s) AS b FROM rk, sz GROUP BY ALL),
f AS (SELECT r, s, abs(sum(b) OVER w / least(s, n)::DOUBLE - sum(a) OVER w / n::DOUBLE) AS d FROM c, n
      WINDOW w AS (PARTITION BY r, s ORDER BY v)),
y AS (SELECT s::DOUBLE AS x, avg(ks) AS y FROM (SELECT r, s, round(max(d), 6) AS ks FROM f GROUP BY r, s) GROUP BY s),
m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, arg_min(y, x) AS yf, arg_max(y, x) AS yl FROM y),
e AS (SELECT x, (x - x0) / (x1 - x0) AS xn, (y - y0) / (y1 - y0) AS yn, (yf - y0) / (y1 - y0) AS a, (yl - y0) / (y1 - y0) AS b FROM y, m)
SELECT x::BIGINT AS sample_size FROM e ORDER BY abs((b - a) * xn - yn + a) DESC, x LIMIT 1""")
def q_rep_size(spark, sf):
    """Smallest sample whose length distribution is representative (KS elbow)."""
    from ..operators.curves import representative_sample_size
    d = docs(spark, sf).withColumn("length_chars", F.length("text"))
    return representative_sample_size(d, "length_chars")
