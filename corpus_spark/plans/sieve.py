"""End-to-end sieve plans.

``flagship`` is the chain script filter -> exact dedup -> Gopher preset ->
better half by characters.  ``run_config`` executes a validated config in the
fixed order load, pre-filter, deduplicate, threshold, partition, split,
language sampling, save; every option is carried out or refused.

Texts are neither cached nor shuffled by the steps.  Documents are cleaned
once and written to the checkpoint folder, as they are read again for the
signals, for near duplicates and at the end (reading them costs a small part of
cleaning them).  The per-document work is projected to ids, scalars and the
exact hash, that table is written as well, the steps decide on it which ids
survive, and one semi join on the id reads the texts again at the end.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signals import GOPHER_THRESHOLDS
from ..functions.text import tokenize
from ..operators import clean, dedup, lm, partition as part, sampling, splits
from ..operators.metrics import compute_metrics
from ..operators.threshold import apply_threshold, threshold_predicate
from ..session import ensure_checkpoint_dir, written
from ..sources.langs import iso3, scripts_for
from .config import PERPLEXITY, SieveConfig

CHARS = "length_chars"
log = logging.getLogger(__name__)


def score_once(df: DataFrame, metrics, with_hash: bool = True, carry: tuple[str, ...] = ("id",),
               tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Metric columns (and the exact hash) in one projection over the text;
    what is left are the ``carry`` columns and scalars."""
    d = compute_metrics(df, list(metrics), tokenizer=tokenizer) if metrics else df
    if with_hash:
        tokens = F.col("tokens") if "tokens" in d.columns else (tokenizer or tokenize)(F.col("text"))
        d = d.withColumn(dedup.HASH_COL, dedup.exact_hash(tokens))
    keep = [c for c in [*carry, *dict.fromkeys(metrics), dedup.HASH_COL] if c in d.columns]
    return d.select(*keep)


def flagship(docs: DataFrame) -> DataFrame:
    cleaned = written(clean.pre_filter(docs, scripts=["Latn"]), "cleaned")
    d = score_once(cleaned, [*GOPHER_THRESHOLDS, CHARS]).checkpoint()
    d = dedup.first_of_each_hash(d).filter(threshold_predicate(GOPHER_THRESHOLDS))
    out = part.partition(d, CHARS, "balanced_chars", quality=True, keep_columns=True, chars_col=CHARS)
    return cleaned.join(out.select("id"), "id", "left_semi").select(*docs.columns)


def load(spark: SparkSession | None, cfg: SieveConfig, df: DataFrame | None,
         tables: Mapping[str, DataFrame] | None) -> DataFrame:
    """The documents of the configured languages: from ``df``, from a saved
    corpus (``load_path``) or from raw source tables (``sources``)."""
    langs = list(dict.fromkeys(iso3(x) for x in cfg.languages))
    if cfg.load_path:
        if df is not None or tables is not None:
            raise ValueError("`load_path` is set, so no table can be given.")
        if spark is None:
            raise ValueError("`load_path` needs a Spark session.")
        from ..sources.io import load_local
        parts = [load_local(spark, cfg.load_path, x).withColumn("language", F.lit(x)) for x in langs]
        return splits.concat_splits(*parts)
    if tables is not None:
        if df is not None:
            raise ValueError("Give one table or raw source tables, not both.")
        from ..sources.adapters import load_sources
        wanted = cfg.sources or list(tables)
        missing = [s for s in wanted if s not in tables]
        if missing:
            raise ValueError(f"No table for the sources {missing}.")
        parts = [load_sources({s: tables[s] for s in wanted}, x).withColumn("language", F.lit(x)) for x in langs]
        d = splits.concat_splits(*parts)
        return d if "id" in d.columns else d.withColumn("id", F.xxhash64(*sorted(d.columns)))
    if df is None:
        raise ValueError("Nothing to load: give a table, `load_path`, or source tables.")
    d = df
    if "language" in d.columns:
        d = d.filter(F.col("language").isin(*langs))
    elif len(langs) > 1:
        raise ValueError("Several languages are configured, but the table has no `language` column.")
    if cfg.sources:
        if "source" not in d.columns:
            raise ValueError("`sources` is set, but the table has no `source` column.")
        d = d.filter(F.col("source").isin(*cfg.sources))
    return d


def _tokenizer(name: str | None, tokenizers: Mapping[str, Callable[[Column], Column]] | None):
    if name is None:
        return None
    if name not in (tokenizers or {}):
        raise ValueError(f"Unknown tokenizer: {name}")
    return tokenizers[name]


def _with_perplexity(d: DataFrame, model: str | None, models: Mapping[str, DataFrame] | None) -> DataFrame:
    """Adds the perplexity signal; the model is counted from the named table,
    or from the documents themselves."""
    if model is not None and model not in (models or {}):
        raise ValueError(f"Unknown model: {model}")
    return lm.perplexity_signal(d, models[model] if model is not None else None)


def run_config(df: DataFrame | None, config: dict | SieveConfig, *, spark: SparkSession | None = None,
               tables: Mapping[str, DataFrame] | None = None,
               tokenizers: Mapping[str, Callable[[Column], Column]] | None = None,
               models: Mapping[str, DataFrame] | None = None, lang_profiles: DataFrame | None = None) -> DataFrame:
    """Run the configured steps over documents (id, text, language, ...).

    ``df``: the documents; or None, with ``load_path`` in the config and
    ``spark``, or with raw source ``tables`` by name.  ``tokenizers`` and
    ``models`` resolve the names in the sections ``deduplicate``,
    ``threshold`` and ``partition``: a tokenizer turns the text column into a
    token array, a model is a table of documents to count a language model
    from.  ``lang_profiles``: profiles for ``lang_id``; by default they are
    trained on the loaded documents of all languages, which needs two.
    """
    cfg = config if isinstance(config, SieveConfig) else SieveConfig.from_dict(config)
    if cfg.streaming:
        raise ValueError("run_config works on tables; use corpus_spark.streaming for streams")
    d = load(spark, cfg, df, tables)
    spark = d.sparkSession
    ensure_checkpoint_dir(spark)
    multilingual = "language" in d.columns
    if cfg.pre_filter:
        d = _pre_filter(d, cfg, multilingual, lang_profiles)
        if cfg.deduplicate or cfg.threshold or cfg.partition:
            d = written(d, "cleaned")
    for section in (cfg.threshold, cfg.partition):
        if section and section.merge_test:
            if "split" not in d.columns:
                raise ValueError("`merge_test` needs a table with splits.")
            d = splits.merge_test_into_train(d)
    alive = _survivors(d, cfg, tokenizers, models)
    if alive is not None:
        d = d.join(alive.select("id"), "id", "left_semi")
    if cfg.split:
        by = ["language"] if multilingual else None
        d = splits.train_test_split(d, cfg.split.test_size, cfg.split.shuffle, cfg.split.seed, by=by)
    if cfg.language_sampling:
        if not multilingual:
            raise ValueError("`language_sampling` needs a table with a `language` column.")
        s = cfg.language_sampling
        weights = s.raw_weights
        if isinstance(weights, str):
            from ..sources.io import read_weights
            weights = {r["language"]: r["weight"] for r in read_weights(spark, weights).collect()}
        d = sampling.apply_language_sampling(d, s.sampling_strategy, s.temperature, s.interleaving_strategy,
                                             weights, s.seed)
    if cfg.save_path:
        from ..sources.io import save_corpus
        save_corpus(d, cfg.save_path)
    return d


def _pre_filter(d: DataFrame, cfg: SieveConfig, multilingual: bool, profiles: DataFrame | None) -> DataFrame:
    pf = cfg.pre_filter
    if not multilingual:
        d = d.withColumn("language", F.lit(iso3(cfg.languages[0])))
    if pf.lang_id and profiles is None:
        if len({iso3(x) for x in cfg.languages}) < 2:
            raise ValueError("`lang_id` on one language needs `lang_profiles`.")
        profiles = lm.train_lang_profiles(d).checkpoint()
    columns = d.columns
    out = clean.apply_pre_filter(d, scripts_for(cfg.languages) if pf.script_regex else None, pf.apply_c4_filter,
                                 pf.urls_to_remove, profiles if pf.lang_id else None).select(*columns)
    if pf.warn_percent:
        n = removed_more_than(d, out, pf.warn_percent).count()
        if n:
            log.warning("pre_filter removed more than %g of the characters of %d documents", pf.warn_percent, n)
    return out if multilingual else out.drop("language")


def removed_more_than(before: DataFrame, after: DataFrame, share: float) -> DataFrame:
    """Ids of documents that lost more than ``share`` of their characters,
    those that are gone altogether included, with the share they lost."""
    old = before.select("id", F.length("text").alias("old")).filter("old > 0")
    new = after.select("id", F.length("text").alias("new"))
    lost = 1 - F.coalesce("new", F.lit(0)) / F.col("old")
    return old.join(new, "id", "left").select("id", lost.alias("removed_frac")).filter(F.col("removed_frac") > share)


def _survivors(d: DataFrame, cfg: SieveConfig, tokenizers, models) -> DataFrame | None:
    """Ids that the steps deduplicate, threshold and partition leave."""
    dd, th, pt = cfg.deduplicate, cfg.threshold, cfg.partition
    if not (dd or th or pt):
        return None
    named = {x.tokenizer for x in (th, pt) if x}
    if len(named) > 1:
        raise ValueError("`threshold` and `partition` must name the same tokenizer.")
    tokenizer = _tokenizer(named.pop(), tokenizers) if named else None
    dedup_tokenizer = _tokenizer(dd.tokenizer, tokenizers) if dd else None
    metrics = (list(th.resolved()) if th else []) + (pt.metric_list() if pt else [])
    if pt and pt.split_method == "balanced_chars":
        metrics.append(CHARS)
    plain = [m for m in dict.fromkeys(metrics) if m != PERPLEXITY]
    carry = tuple(c for c in ("id", "language", "split", PERPLEXITY) if c in d.columns or c == PERPLEXITY)
    source = d
    if PERPLEXITY in metrics:
        wanted = {x.model for x in (th, pt) if x}
        if len(wanted) > 1:
            raise ValueError("`threshold` and `partition` must name the same model.")
        source = _with_perplexity(d, wanted.pop(), models)
    elif any(x and x.model for x in (th, pt)):
        raise ValueError("`model` is only used by the metric perplexity.")
    exact = bool(dd and dd.exact_match)
    same = dedup_tokenizer is tokenizer
    alive = score_once(source, plain, exact and same, carry, tokenizer).checkpoint()
    if exact and not same:
        alive = alive.join(score_once(d, [], True, ("id",), dedup_tokenizer), "id")
    if dd:
        gone = dedup.near_duplicate_ids(d, dd.jaccard_threshold, dd.n_shingles, tokenizer=dedup_tokenizer) \
            if dd.min_hash else None
        if exact:
            alive = dedup.first_of_each_hash(alive)
        if gone is not None:
            alive = alive.join(gone, "id", "left_anti")
    if th:
        alive = apply_threshold(alive, th.resolved(), keep_columns=True)
    if pt:
        alive = part.partition(alive, pt.metrics, pt.split_method, pt.quality, pt.join_partitions_by,
                               keep_columns=True, chars_col=CHARS if CHARS in alive.columns else None)
    return alive
