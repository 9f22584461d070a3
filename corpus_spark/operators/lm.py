"""Count-based language models on Spark: the perplexity signal and a
character n-gram language identifier.

Perplexity (re-aimed from a neural LM on one GPU): a trigram model with
back-off is counted from a training table; documents are scored by looking
their trigrams up in shards of the counts (``ngram_blocks``); per-document
perplexity is exp(-mean log p); the signal is |ppl - median(ppl)| (lower is
better), with the exact distributed median.

Language id (the reference's line-level model filter): per-language
character-trigram log-probabilities are counted on Spark; a line's language
is the argmax of its summed log-probabilities, computed inside the scan by the
profile table, or by a join where that is too large to go to every task.
"""

from __future__ import annotations

import functools
import math
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import char_ngrams, splitlines, strip
from ..session import ensure_checkpoint_dir, written
from . import chargrams, ngram_blocks as blocks


#: Weight of each step back to a shorter context.
BACK_OFF = 0.4


def _numbered(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """``(number, text)``: rows of one id (null is one) have one number."""
    return df.select((F.xxhash64(id_col) if id_col else F.lit(0).cast("long")).alias("number"), F.col(text_col).alias("text"))


def _characters(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]


def train_trigram_lm(train: DataFrame, text_col: str = "text") -> dict:
    """A trigram model of a training table: ``texts``, whose trigrams and
    bigrams :func:`token_losses` counts a part at a time; ``words``, the counts
    of all tokens in blocks of ``shards`` shards; ``tokens`` and ``types``, the
    numbers of all and of distinct tokens; ``chars``, of characters."""
    spark, texts = train.sparkSession, _numbered(train, None, text_col)
    classes = spark.sparkContext.broadcast(blocks.token_classes(spark))
    chars = _characters(texts)
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(chars / blocks.SHARD_CHARS / 4))
    words = blocks.Scratch(spark).write(blocks.count_words(texts, classes, shards), "lm-words")
    types = F.coalesce(F.sum(F.length("item") / 8), F.lit(0)).cast("long")
    count = F.udf(lambda n: int(np.frombuffer(n, np.int64).sum()), "long")
    tokens, types = words.agg(F.coalesce(F.sum(count("n")), F.lit(0)), types).first()
    return {"texts": texts, "words": words, "shards": shards, "tokens": tokens, "types": types, "chars": chars}


def token_losses(df: DataFrame, lm: dict, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Per-document mean negative log-likelihood (natural log) and token count
    under stupid back-off: the trigram's relative frequency, or ``BACK_OFF``
    times the bigram's, or ``BACK_OFF`` squared times the token's (add-one
    smoothed, also for a token that was never seen).

    Trigrams are worked off in rounds (:mod:`ngram_blocks`): counted and looked
    up by 64-bit hashes in shards, without a row for each token."""
    spark, texts = df.sparkSession, _numbered(df, id_col, text_col)
    scratch = blocks.Scratch(spark)
    classes = spark.sparkContext.broadcast(blocks.token_classes(spark))
    chars = _characters(texts) + lm["chars"]
    rounds = min(blocks.ROUNDS, math.ceil(chars / blocks.ROUND_CHARS) or 1)
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(chars / blocks.SHARD_CHARS / rounds))
    back, words = math.log(BACK_OFF), (1, math.log(lm["tokens"] + lm["types"] + 1))
    sums, unknown = [], []
    for turn in range(rounds):
        part = (shards, rounds, turn)
        tri = blocks.scan(lm["texts"], classes, "tri", blocks.TRAIN, *part) \
            .unionByName(blocks.scan(texts, classes, "tri", blocks.ASKED, *part))
        found = scratch.write(blocks.look_up(tri, "tri", shards, rounds, shards, 0.0, words), "lm-tri")
        sums.append(scratch.write(blocks.document_sums(found), "lm-sums"))
        asked = found.filter(F.col("kind") == blocks.ASKED)
        if not asked.isEmpty():
            bi = blocks.scan(lm["texts"], classes, "bi", blocks.TRAIN, *part).unionByName(asked)
            less = scratch.write(blocks.look_up(bi, "bi", shards, rounds, lm["shards"], back, words), "lm-bi")
            sums.append(scratch.write(blocks.document_sums(less), "lm-sums"))
            unknown.append(scratch.write(less.filter(F.col("kind") == blocks.ASKED), "lm-words-asked"))
            scratch.drop(less)
        scratch.drop(found)
    for asked in unknown:
        word = blocks.look_up(lm["words"].unionByName(asked), "word", lm["shards"], 1, 1, 2 * back, words)
        sums.append(scratch.write(blocks.document_sums(word), "lm-sums"))
    losses = functools.reduce(DataFrame.unionByName, sums).groupBy("number").agg(F.sum("lp").alias("lp"), F.sum("n").alias("n"))
    ids = df.select(id_col).distinct().withColumn("number", F.xxhash64(id_col))
    return ids.join(losses, "number").select(id_col, (-F.col("lp") / F.col("n")).alias("loss"), F.col("n").alias("n_tokens"))


def perplexity_signal(df: DataFrame, train: DataFrame | None = None,
                      id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Add ``perplexity`` = |ppl - median(ppl)| (documents without tokens get
    the empty-sequence loss 0, i.e. ppl 1)."""
    from .partition import median_value
    lm = train_trigram_lm(train if train is not None else df, text_col)
    losses = token_losses(df, lm, id_col, text_col)
    ensure_checkpoint_dir(df.sparkSession)
    # ids and scores are written, the text is read again by the join
    scored = df.select(id_col).join(losses, id_col, "left") \
        .select(id_col, F.exp(F.coalesce("loss", F.lit(0.0))).alias("__ppl")).checkpoint()
    med = median_value(scored, "__ppl", id_col)
    return df.join(scored, id_col).withColumn("perplexity", F.abs(F.col("__ppl") - F.lit(med))).drop("__ppl")


# --- language identification --------------------------------------------------------
def train_lang_profiles(df: DataFrame, language_col: str = "language", text_col: str = "text",
                        n: int = 3, k: float = 1.0) -> DataFrame:
    """``(language, gram, logp)``: add-k smoothed log-probability of every
    character n-gram seen in a language's documents.  N-grams of up to
    ``chargrams.MAX_N`` characters are counted inside the scan."""
    src = df.select(language_col, F.lower(F.col(text_col)).alias("text")).filter(F.col(language_col).isNotNull())
    if n <= chargrams.MAX_N:
        out = T.StructType([T.StructField(language_col, df.schema[language_col].dataType),
                            T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])
        ex = src.mapInArrow(chargrams.counter(n, to_arrow_schema(out)), out)
    else:
        ex = src.select(language_col, F.explode(char_ngrams("text", n)).alias("gram"), F.lit(1).alias("c"))
    cnt = ex.groupBy(language_col, "gram").agg(F.sum("c").alias("c"))
    tot = cnt.groupBy(language_col).agg(F.sum("c").alias("tot"), F.count(F.lit(1)).alias("types"))
    return cnt.join(F.broadcast(tot), language_col).select(
        language_col, "gram", F.log((F.col("c") + k) / (F.col("tot") + k * (F.col("types") + 1))).alias("logp"))


#: (Language, n-gram) pairs of the profiles that go to every task.  Lines with n-grams that these leave out are
#: scored by a join.
PROFILE_CELLS = 1 << 21


def _head(profiles: DataFrame, floors: dict, n: int) -> chargrams.Profiles:
    """The likeliest n-grams of ``profiles``, with all their languages: all of
    them where they are at most ``PROFILE_CELLS`` pairs."""
    most = max(PROFILE_CELLS // len(floors), 1)
    grams = profiles.groupBy("gram").agg(F.max("logp").alias("top"))
    whole = profiles.count() <= most or grams.count() <= most
    if not whole:
        profiles = profiles.join(grams.orderBy(F.desc("top"), "gram").limit(most), "gram", "left_semi")
    return chargrams.Profiles(profiles.select("language", "gram", "logp").toArrow(), floors, n, whole)


def _predict_by_join(lines: DataFrame, profiles: DataFrame, floors: dict, id_col: str, n: int) -> DataFrame:
    """``(id, line_no, line, pred)`` of ``(id, line_no, line)``: n-grams are
    counted per line before the join, and the profiles are one row for each
    n-gram (a map over the languages), so the join has no fan-out."""
    grams = lines.select(id_col, "line_no", F.explode(char_ngrams(F.lower("line"), n)).alias("gram")) \
        .groupBy(id_col, "line_no", "gram").agg(F.count(F.lit(1)).alias("c"))
    floor = F.create_map(*[F.lit(x) for pair in sorted(floors.items()) for x in pair])
    known = profiles.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("language", "logp"))).alias("p"))
    hits = grams.join(known, "gram").select(id_col, "line_no", "c", F.explode("p").alias("language", "logp"))
    gain = hits.groupBy(id_col, "line_no", "language").agg(
        F.sum(F.col("c") * (F.col("logp") - floor[F.col("language")])).alias("gain"))
    sizes = grams.groupBy(id_col, "line_no").agg(F.sum("c").alias("ng"))
    best = gain.join(sizes, [id_col, "line_no"]) \
        .withColumn("score", F.col("gain") + F.col("ng") * floor[F.col("language")]) \
        .groupBy(id_col, "line_no").agg(F.max_by("language", F.struct("score", F.col("language"))).alias("pred"))
    return lines.join(best, [id_col, "line_no"], "left")


def predict_line_languages(df: DataFrame, profiles: DataFrame, id_col: str = "id", text_col: str = "text",
                           language_col: str = "language", n: int = 3) -> DataFrame:
    """``(id, line_no, line, pred)``: the most likely language of each
    stripped, non-blank line.  An n-gram that a language's profile lacks scores
    its smallest logp.  ``pred`` is NULL for lines shorter than an n-gram, for
    lines none of whose n-grams is in any profile, and without an id.

    Lines are scored inside the scan, by profiles of bounded size that every
    task has.  By a join go the lines of ids that several documents share
    (lines of one number count as one), lines with an n-gram beyond that size,
    and all lines where n is above ``chargrams.MAX_N``."""
    spark = df.sparkSession
    profiles = written(profiles.select(F.col(language_col).alias("language"), "gram", "logp"), "lang-profiles")
    # one row for each language
    floors = {r["language"]: r["floor"] for r in profiles.groupBy("language").agg(F.min("logp").alias("floor")).collect()}
    text_lines = F.filter(F.transform(splitlines(F.col(text_col)), lambda l: strip(l)), lambda l: l != "")
    exploded = lambda d: d.select(id_col, F.posexplode(text_lines).alias("line_no", "line"))
    if not floors:
        return exploded(df).withColumn("pred", F.lit(None).cast("string"))
    if n > chargrams.MAX_N:
        return _predict_by_join(exploded(df), profiles, floors, id_col, n)
    shared = written(df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
                     .filter("__n > 1").select(id_col), "shared-ids")
    some_shared = not shared.isEmpty()
    single = df.join(shared, id_col, "left_anti") if some_shared else df
    head = _head(profiles, floors, n)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("line", T.ArrayType(T.StringType())),
                        T.StructField("pred", T.ArrayType(T.StringType())),
                        T.StructField("settled", T.ArrayType(T.BooleanType()))])
    scan = single.select(id_col, F.coalesce(text_lines, F.array().cast("array<string>")).alias("line"))
    rows = scan.select(id_col, "line", F.transform("line", lambda l: F.lower(l)).alias("low")) \
        .mapInArrow(chargrams.line_scorer(spark.sparkContext.broadcast(head), to_arrow_schema(out)), out) \
        .select(id_col, F.posexplode(F.arrays_zip("line", "pred", "settled")).alias("line_no", "l"))
    pred = F.when(F.col(id_col).isNotNull(), F.col("l.pred")).alias("pred")
    done = rows if head.whole else rows.filter("l.settled")
    result = done.select(id_col, "line_no", "l.line", pred)
    if not head.whole:
        rest = rows.filter("NOT l.settled").select(id_col, "line_no", "l.line")
        result = result.unionByName(_predict_by_join(rest, profiles, floors, id_col, n))
    if some_shared:
        result = result.unionByName(_predict_by_join(exploded(df.join(shared, id_col, "left_semi")), profiles, floors, id_col, n))
    return result


def lang_id_filter(df: DataFrame, profiles: DataFrame, keep: Sequence[str] | None = None, id_col: str = "id",
                   text_col: str = "text", language_col: str = "language", n: int = 3) -> DataFrame:
    """Keep only lines predicted to be in ``keep`` (by default: in the
    document's own ``language_col``); documents left without lines are
    dropped.  Lines shorter than an n-gram cannot be told apart and stay; a
    line of n-grams that no profile has is in no known language and goes.
    Lines are put together again in their original order."""
    columns = [id_col, text_col] + ([language_col] if keep is None else [])
    src = df.select(*columns)
    pred = predict_line_languages(src, profiles, id_col, text_col, "language", n)
    if keep is None:
        pred = pred.join(src.select(id_col, F.col(language_col).alias("__own")), id_col)
        ok = F.col("pred") == F.col("__own")
    else:
        ok = F.col("pred").isin(*keep)
    kept = pred.filter(F.coalesce(ok, F.lit(False)) | (F.length("line") < n))
    texts = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls")) \
        .select(id_col, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("__t"))
    return df.join(texts, id_col, "inner").drop(text_col).withColumnRenamed("__t", text_col)
