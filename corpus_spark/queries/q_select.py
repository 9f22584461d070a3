"""Queries for thresholds, quality halves, deduplication and the flagship sieve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signals import GOPHER_THRESHOLDS, get_metric
from ..operators import clean, dedup, partition as part, threshold as thr
from ..operators.metrics import compute_metrics, with_tokens
from ..sources.tables import read_documents
from . import sqlfrag as S
from .registry import register

DOCS = S.DOCS
TOKD = f"(SELECT *, {S.tok('text')} AS tokens FROM {DOCS})"


def docs(spark, sf):
    return read_documents(spark, sf)


def sql_pass(thresholds: dict, k: str = "tokens") -> str:
    conds = []
    for name, t in thresholds.items():
        op = ">=" if get_metric(name).higher_is_better else "<="
        conds.append(f"coalesce({S.metric_sql(name, 'text', k)} {op} {t}, false)")
    return " AND ".join(conds)


# --- thresholds ---------------------------------------------------------------
T1 = {"length_words": 100, "frac_unique_words": 0.3, "frac_symbol_to_words": 0.05}


@register("apply_threshold", f"SELECT id FROM {TOKD} WHERE {sql_pass(T1)}")
def q_apply_threshold(spark, sf):
    return thr.apply_threshold(docs(spark, sf), T1).select("id")


@register("gopher_threshold", f"SELECT id, text FROM {TOKD} WHERE {sql_pass(GOPHER_THRESHOLDS)}")
def q_gopher(spark, sf):
    return thr.gopher_threshold(docs(spark, sf)).select("id", "text")


def _report_sql(thresholds):
    cols = []
    for name, t in thresholds.items():
        op = ">=" if get_metric(name).higher_is_better else "<="
        cols.append(f"count(*) FILTER (WHERE NOT coalesce({S.metric_sql(name)} {op} {t}, false))::BIGINT AS removed_{name}")
    cols.append(f"count(*) FILTER (WHERE NOT ({sql_pass(thresholds)}))::BIGINT AS removed_total")
    cols.append("count(*)::BIGINT AS docs")
    return f"SELECT {', '.join(cols)} FROM {TOKD}"


@register("threshold_report", _report_sql(GOPHER_THRESHOLDS))
def q_threshold_report(spark, sf):
    return thr.threshold_report(docs(spark, sf), GOPHER_THRESHOLDS)


def _auto_sql(metric: str) -> str:
    """Estimated threshold of a higher-is-better metric: the tail's and the
    sample's binned densities on a grid of 2048 points, then on as many between
    the neighbours of the best one."""
    bins, grid = thr.HIST_BINS, thr.GRID_POINTS

    def best(name: str, lo: str, hi: str, source: str) -> str:
        def density(part: str) -> str:
            return (f"(SELECT i, sum(c * exp(-0.5 * pow((x - (s.lo + (b + 0.5) * s.wd)) / {part}_bw, 2))) / any_value(s.n * {part}_bw) "
                    f"AS d FROM {name}_g, h_{part}, s GROUP BY i)")
        return (f"{name}_g AS (SELECT i, {lo} + i * (({hi}) - ({lo})) / {grid - 1} AS x FROM {source}, "
                f"(SELECT unnest(range({grid})) AS i)), "
                f"{name} AS (SELECT arg_max(i, t.d - u.d) AS i FROM {density('t')} t JOIN {density('u')} u USING (i))")

    return f"""
WITH m AS (SELECT id, {S.metric_sql(metric)} AS k FROM {TOKD}), z AS (SELECT (count(*) * 0.05)::DOUBLE AS z FROM m),
v AS (SELECT id, k::DOUBLE AS v, row_number() OVER (ORDER BY k, id) AS rt, row_number() OVER
        (ORDER BY ('0x' || substr(md5('42:' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE, id) AS ru, floor(z)::BIGINT AS n FROM m, z),
s0 AS (SELECT any_value(n) AS n, min(v) FILTER (rt <= n) AS tmin, max(v) FILTER (rt <= n) AS tmax, stddev_samp(v) FILTER (rt <= n) AS tsd,
              min(v) FILTER (ru <= n) AS umin, max(v) FILTER (ru <= n) AS umax, stddev_samp(v) FILTER (ru <= n) AS usd FROM v),
s AS (SELECT *, least(tmin, umin) AS lo, (greatest(tmax, umax) - least(tmin, umin)) / {bins} AS wd,
             tsd * pow(n, -0.2) AS t_bw, usd * pow(n, -0.2) AS u_bw FROM s0),
h_t AS (SELECT least(floor((v - lo) / wd), {bins - 1}) AS b, count(*) AS c FROM v, s WHERE rt <= v.n GROUP BY 1),
h_u AS (SELECT least(floor((v - lo) / wd), {bins - 1}) AS b, count(*) AS c FROM v, s WHERE ru <= v.n GROUP BY 1),
{best('g1', 's.tmin', 's.umax', 's')},
e AS (SELECT min(x) AS a, max(x) AS z FROM g1_g, g1 WHERE abs(g1_g.i - g1.i) <= 1),
{best('g2', 'e.a', 'e.z', 'e')},
t AS (SELECT x AS t FROM g2_g JOIN g2 USING (i))
SELECT id, k AS {metric} FROM m, t WHERE k >= t"""


@register("auto_threshold", _auto_sql("unique_words"))
def q_auto_threshold(spark, sf):
    """Estimated threshold on unique_words (KDE of the 5 % tail vs. a seeded sample)."""
    return thr.apply_threshold(docs(spark, sf), {"unique_words": "auto"}, keep_columns=True) \
        .select("id", "unique_words")


# --- quality halves ------------------------------------------------------------
def _m(name):
    return S.metric_sql(name)


def _high_sql(metric, method):
    m = _m(metric)
    if method == "mean_cutoff":
        return f"SELECT id FROM (SELECT id, {m} AS m, avg({m}) OVER () AS c FROM {TOKD}) WHERE m >= c"
    if method == "median_cutoff":
        return f"SELECT id FROM (SELECT id, {m} AS m, median({m}) OVER () AS c FROM {TOKD}) WHERE m >= c"
    if method == "balanced_docs":
        return (f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {m}, id) AS rn, count(*) OVER () AS n "
                f"FROM {TOKD}) WHERE rn > n // 2")
    if method == "balanced_chars":
        return (f"SELECT id FROM (SELECT id, sum(length(text)) OVER (ORDER BY {m}, id ROWS UNBOUNDED PRECEDING) AS cum, "
                f"sum(length(text)) OVER () AS tot FROM {TOKD}) WHERE cum > tot // 2")
    raise ValueError(method)


@register("partition_mean", _high_sql("length_words", "mean_cutoff"))
def q_part_mean(spark, sf):
    return part.partition(docs(spark, sf), "length_words", "mean_cutoff").select("id")


@register("partition_median", _high_sql("unique_words", "median_cutoff"))
def q_part_median(spark, sf):
    return part.partition(docs(spark, sf), "unique_words", "median_cutoff").select("id")


@register("partition_balanced_docs", _high_sql("frac_unique_words", "balanced_docs"))
def q_part_bdocs(spark, sf):
    return part.partition(docs(spark, sf), "frac_unique_words", "balanced_docs").select("id")


@register("partition_balanced_chars", _high_sql("length_chars", "balanced_chars"))
def q_part_bchars(spark, sf):
    return part.partition(docs(spark, sf), "length_chars", "balanced_chars").select("id")


@register("partition_elbow")
def q_part_elbow(spark, sf):
    """Knee of the descending length_words curve (degree-7 polynomial Kneedle);
    quality=True on this higher-is-better metric keeps the part after the
    knee, as the reference does."""
    return part.partition(docs(spark, sf), "length_words", "elbow").select("id")


@register("partition_balanced_chars_by_language", f"""
SELECT id, language FROM (SELECT id, language,
  sum(length(text)) OVER (PARTITION BY language ORDER BY {_m('length_words')}, id ROWS UNBOUNDED PRECEDING) AS cum,
  sum(length(text)) OVER (PARTITION BY language) AS tot FROM {TOKD}) WHERE cum > tot // 2""")
def q_part_bchars_lang(spark, sf):
    """balanced_chars on length_words within each language (``by=["language"]``)."""
    return part.partition(docs(spark, sf), "length_words", "balanced_chars", by=["language"]).select("id", "language")


# lower-is-better metric with quality=True returns the LOW side; quality=False the high side
@register("partition_low_quality", f"""
SELECT id FROM (SELECT id, {_m('frac_symbol_to_words')} AS m, avg({_m('frac_symbol_to_words')}) OVER () AS c FROM {TOKD})
WHERE m >= c""")
def q_part_lowq(spark, sf):
    return part.partition(docs(spark, sf), "frac_symbol_to_words", "mean_cutoff", quality=False).select("id")


@register("partition_intersection",
          f"({_high_sql('length_words', 'mean_cutoff')}) INTERSECT ({_high_sql('frac_unique_words', 'mean_cutoff')})")
def q_part_inter(spark, sf):
    return part.partition(docs(spark, sf), ["length_words", "frac_unique_words"], "mean_cutoff",
                          join_partitions_by="intersection").select("id")


@register("partition_union",
          f"({_high_sql('length_words', 'mean_cutoff')}) UNION ({_high_sql('frac_unique_words', 'mean_cutoff')})")
def q_part_union(spark, sf):
    return part.partition(docs(spark, sf), ["length_words", "frac_unique_words"], "mean_cutoff",
                          join_partitions_by="union").select("id")


def _combined_sql(metrics):
    parts = []
    for m in metrics:
        e = _m(m)
        parts.append(f"coalesce(({e} - min({e}) OVER ())::DOUBLE / nullif(max({e}) OVER () - min({e}) OVER (), 0), 0.0)")
    return " + ".join(parts)


@register("combined_score", f"""
SELECT id, round({_combined_sql(['length_words', 'frac_unique_words', 'unigram_entropy'])}, 6) AS combined_metrics
FROM {TOKD}""")
def q_combined(spark, sf):
    d = compute_metrics(docs(spark, sf), ["length_words", "frac_unique_words", "unigram_entropy"])
    d = part.combined_score(d, ["length_words", "frac_unique_words", "unigram_entropy"])
    return d.select("id", F.round("combined_metrics", 6).alias("combined_metrics"))


@register("partition_combined", f"""
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY s, id) AS rn, count(*) OVER () AS n FROM
  (SELECT id, {_combined_sql(['length_words', 'frac_unique_words'])} AS s FROM {TOKD})) WHERE rn > n // 2""")
def q_part_combined(spark, sf):
    return part.partition(docs(spark, sf), ["length_words", "frac_unique_words"], "balanced_docs").select("id")


@register("keep_metric_columns", f"""
SELECT id, {S.metric_out('length_words')}, {S.metric_out('doc_mean_word_length')} FROM {TOKD}
WHERE {sql_pass({'length_words': 50, 'doc_mean_word_length': 3})}""")
def q_keep_cols(spark, sf):
    d = thr.apply_threshold(docs(spark, sf), {"length_words": 50, "doc_mean_word_length": 3}, keep_columns=True)
    return d.select("id", "length_words", F.round("doc_mean_word_length", 6).alias("doc_mean_word_length"))


# --- deduplication --------------------------------------------------------------
@register("exact_hash", f"SELECT id, md5(array_to_string(tokens, '')) AS hash FROM {TOKD}")
def q_exact_hash(spark, sf):
    return with_tokens(docs(spark, sf)).select("id", dedup.exact_hash(F.col("tokens")).alias("hash"))


@register("dedup_exact", f"""
SELECT id, text FROM {TOKD} WHERE id IN (SELECT min(id) FROM {TOKD} GROUP BY md5(array_to_string(tokens, '')))""")
def q_dedup_exact(spark, sf):
    return dedup.dedup_exact(docs(spark, sf)).select("id", "text")


SH3 = f"list_distinct({S.ngrams('tokens', 3)})"


@register("shingles", f"""
SELECT id, len({SH3})::BIGINT AS n_shingles, md5(array_to_string(list_sort({SH3}), chr(10))) AS shingles_md5 FROM {TOKD}""")
def q_shingles(spark, sf):
    sh = dedup.shingles(F.col("tokens"), 3)
    return with_tokens(docs(spark, sf)).select(
        "id", F.size(sh).cast("long").alias("n_shingles"), F.md5(F.array_join(F.array_sort(sh), "\n")).alias("shingles_md5"))


def _sig_sql(n_shingles: int, tokd: str = TOKD) -> str:
    perms = ", ".join(f"coalesce(min(({a} * h + {b}) % {dedup.PRIME}), {dedup.EMPTY_SENTINEL})"
                      for a, b in dedup.PERMS)
    sh = f"list_distinct({S.ngrams('tokens', n_shingles)})"
    return f"""(SELECT id, [{perms}] AS sig FROM (
  SELECT id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM (
    SELECT id, unnest(CASE WHEN len({sh}) = 0 THEN [NULL]::VARCHAR[] ELSE {sh} END) AS s FROM {tokd}))
  GROUP BY id)"""


@register("minhash_signature", f"SELECT id, array_to_string(sig, ',') AS sig FROM {_sig_sql(3)}")
def q_minhash(spark, sf):
    s = dedup.minhash_signatures(docs(spark, sf), n_shingles=3)
    return s.select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def _bands_sql(threshold, n_shingles, tokd=TOKD):
    b, r = dedup.optimal_bands(threshold)
    keys = ", ".join(f"md5(array_to_string(sig[{j * r + 1}:{j * r + r}], ','))" for j in range(b))
    return f"(SELECT id, unnest(range({b}))::INTEGER AS band, unnest([{keys}]) AS bkey FROM {_sig_sql(n_shingles, tokd)})"


@register("lsh_bands", f"SELECT id, band, bkey FROM {_bands_sql(0.8, 3)}")
def q_lsh_bands(spark, sf):
    return dedup.lsh_buckets(dedup.minhash_signatures(docs(spark, sf), n_shingles=3), 0.8)


@register("lsh_candidates", f"""
WITH b AS {_bands_sql(0.8, 3)},
bs AS (SELECT band, bkey, min(id) AS m1, count(*) AS n FROM b GROUP BY band, bkey),
b2 AS (SELECT b.band, b.bkey, min(b.id) AS m2 FROM b JOIN bs USING (band, bkey) WHERE b.id > bs.m1 GROUP BY b.band, b.bkey),
per AS (SELECT b.id, CASE WHEN b.id = bs.m1 THEN b2.m2 ELSE bs.m1 END AS other, bs.n FROM b JOIN bs USING (band, bkey)
        LEFT JOIN b2 USING (band, bkey))
SELECT id, min(other) AS first_candidate, count(*) FILTER (WHERE n >= 2)::BIGINT AS shared_buckets
FROM per GROUP BY id""")
def q_lsh_candidates(spark, sf):
    return dedup.lsh_candidates(dedup.lsh_buckets(dedup.minhash_signatures(docs(spark, sf), n_shingles=3), 0.8))


@register("jaccard_verify", f"""
WITH b AS {_bands_sql(0.8, 3)},
c AS (SELECT DISTINCT x.id, y.id AS candidate FROM b x JOIN b y USING (band, bkey) WHERE x.id < y.id),
s AS (SELECT id, {SH3} AS s FROM {TOKD}),
j AS (SELECT c.id, candidate, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n
      FROM c JOIN s x ON x.id = c.id JOIN s y ON y.id = candidate)
SELECT id, candidate, round(CASE WHEN n > 0 THEN i / (n - i) ELSE 1.0 END, 6) AS jaccard FROM j""")
def q_jaccard_verify(spark, sf):
    """Exact similarity of all pairs of documents that are LSH candidates."""
    d = docs(spark, sf)
    pairs = dedup.jaccard_verify(d, dedup.lsh_buckets(dedup.minhash_signatures(d, n_shingles=3), 0.8), 3)
    return pairs.select("id", "candidate", F.round("jaccard", 6).alias("jaccard"))


def _near_sql(threshold, n_shingles, tokd=TOKD):
    edges = f"SELECT id, band::VARCHAR || bkey AS bucket FROM {_bands_sql(threshold, n_shingles, tokd)}"
    return f"({S.greedy_sql(edges)})"


def _firsts_sql(tokd=TOKD):
    return f"(SELECT min(id) FROM {tokd} GROUP BY md5(array_to_string(tokens, '')))"


@register("dedup_minhash", f"SELECT id FROM {DOCS} WHERE id NOT IN {_near_sql(0.8, 3)}")
def q_dedup_minhash(spark, sf):
    """Greedy MinHash-LSH dedup (3-shingles, threshold 0.8) over the whole table."""
    return dedup.deduplicate(docs(spark, sf), min_hash=True, jaccard_threshold=0.8, n_shingles=3).select("id")


@register("deduplicate", f"SELECT id FROM {DOCS} WHERE id IN {_firsts_sql()} AND id NOT IN {_near_sql(0.85, 1)}")
def q_deduplicate(spark, sf):
    """Exact + MinHash: a document stays when it passes both, each over all documents."""
    return dedup.deduplicate(docs(spark, sf), exact_match=True, min_hash=True,
                             jaccard_threshold=0.85, n_shingles=1).select("id")


SPACED = f"(SELECT *, string_split_regex(lower({S.strip('text')}), '[{S.SQL_SPACE}]+') AS tokens FROM {DOCS})"


@register("deduplicate_tokenized",
          f"SELECT id FROM {DOCS} WHERE id IN {_firsts_sql(SPACED)} AND id NOT IN {_near_sql(0.8, 3, SPACED)}")
def q_dedup_tok(spark, sf):
    """Dedup on the tokens of a supplied tokenizer (lower-cased white-space split)."""
    d = with_tokens(docs(spark, sf), tokenizer=lambda t: F.split(F.lower(clean.strip(t)), r"(?U)\s+"))
    return dedup.deduplicate(d, exact_match=True, min_hash=True, jaccard_threshold=0.8, n_shingles=3).select("id")


# --- flagship ----------------------------------------------------------------------
def flagship(d):
    from ..plans.sieve import flagship as plan
    return plan(d)


FLAGSHIP_SQL = f"""
WITH pf AS (SELECT id, {S.clean_lines('text', ['Latn'])} AS text, language, source FROM {DOCS}),
pf2 AS (SELECT *, {S.tok('text')} AS tokens FROM pf WHERE {S.strip('text')} <> ''),
ex AS (SELECT * FROM pf2 WHERE id IN (SELECT min(id) FROM pf2 GROUP BY md5(array_to_string(tokens, '')))),
g AS (SELECT * FROM ex WHERE {sql_pass(GOPHER_THRESHOLDS)}),
c AS (SELECT *, sum(length(text)) OVER (ORDER BY length(text), id ROWS UNBOUNDED PRECEDING) AS cum,
             sum(length(text)) OVER () AS tot FROM g)
SELECT id, text, language, source FROM c WHERE cum > tot // 2"""


@register("flagship_sieve", FLAGSHIP_SQL)
def q_flagship(spark, sf):
    return flagship(docs(spark, sf)).select("id", "text", "language", "source")


@register("flagship_sieve_minhash", f"""
WITH pf AS (SELECT id, {S.clean_lines('text', ['Latn'])} AS text, language, source FROM {DOCS}),
pf2 AS MATERIALIZED (SELECT *, {S.tok('text')} AS tokens FROM pf WHERE {S.strip('text')} <> ''),
ex AS (SELECT * FROM pf2 WHERE id IN {_firsts_sql('pf2')} AND id NOT IN {_near_sql(0.8, 3, 'pf2')}),
g AS (SELECT * FROM ex WHERE {sql_pass(GOPHER_THRESHOLDS)}),
c AS (SELECT *, sum(length(text)) OVER (ORDER BY length(text), id ROWS UNBOUNDED PRECEDING) AS cum,
             sum(length(text)) OVER () AS tot FROM g)
SELECT id, text, language, source FROM c WHERE cum > tot // 2""")
def q_flagship_minhash(spark, sf):
    """README chain with MinHash too: script filter, exact + MinHash dedup
    (3-shingles, 0.8), Gopher preset, balanced_chars on length_chars."""
    from ..plans.sieve import run_config
    cfg = {"experiment": "flagship", "languages": ["eng", "fra", "deu", "spa"],
           "pre_filter": {"script_regex": True},
           "deduplicate": {"exact_match": True, "min_hash": True, "jaccard_threshold": 0.8, "n_shingles": 3},
           "threshold": {"preset": "gopher"},
           "partition": {"split_method": "balanced_chars", "metrics": "length_chars", "quality": True}}
    return run_config(docs(spark, sf), cfg).select("id", "text", "language", "source")


_RUN = f"""
SELECT id, language, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, language, count(*) OVER (PARTITION BY language) AS n, row_number() OVER (PARTITION BY language
    ORDER BY ('0x' || substr(md5('1:' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE, id) AS rn
  FROM (SELECT *, avg(m1) OVER () AS a1, avg(m2) OVER () AS a2 FROM (
    SELECT id, language, {_m('unique_words')} AS m1, {_m('frac_unique_words')} AS m2 FROM (
      SELECT * FROM (SELECT *, {S.tok('text')} AS tokens FROM (
        SELECT id, language, {S.clean_lines('text', ['Latn'], c4=True)} AS text FROM {DOCS}) WHERE {S.strip('text')} <> '')
      QUALIFY id = min(id) OVER (PARTITION BY md5(array_to_string(tokens, ''))))
    WHERE {sql_pass({'length_words': 20})})) WHERE m1 >= a1 OR m2 >= a2)"""


@register("run_config", S.sample_sql(_RUN, S.COUNTS, "pow(w, 1.0 / 0.5)", "min", extra=", i.split"))
def q_run_config(spark, sf):
    """Config-driven run: pre-filter (per-language scripts + C4), exact dedup,
    a fixed threshold, mean-cutoff partition on two metrics (union),
    per-language 10 % test split and temperature language sampling."""
    from ..plans.sieve import run_config
    cfg = {"experiment": "config", "languages": ["eng", "fra", "deu", "spa"],
           "pre_filter": {"script_regex": True, "apply_c4_filter": True},
           "deduplicate": {"exact_match": True},
           "threshold": {"thresholds": {"length_words": 20}},
           "partition": {"split_method": "mean_cutoff", "metrics": ["unique_words", "frac_unique_words"],
                         "join_partitions_by": "union"},
           "split": {"test_size": 0.1, "seed": 1},
           "language_sampling": {"sampling_strategy": "temperature", "temperature": 0.5,
                                 "interleaving_strategy": "first_exhausted"}}
    return run_config(docs(spark, sf), cfg).select("t", "id", "language", "split")
