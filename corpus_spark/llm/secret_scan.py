"""Secrets in texts, with DataFrame functions only.

Three patterns find the usual forms of credentials.  Beyond them, runs of
token characters are scored by two first-order Markov models of characters,
one of random strings and one of ordinary identifiers; a run whose
log-likelihood ratio speaks for the random model is a secret too.

The models are counts of character pairs in labelled samples: values that the
patterns find are random strings, all other runs are ordinary.  They are
learned from a bounded number of documents (``sample_docs`` for either label,
those with the lowest hashes of doc_id and text among ``search`` times as many)
and have one entry for each pair of the alphabet.

Positions come from splitting a text at a pattern: the lengths of the pieces
between matches and of the matches add up, in a window over the text's
matches, to the code points at which they begin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lowest_values, unused

#: Fixed patterns of the task; letters of the key words in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}
#: The same matches without those that are too short: a run that fails leaves nothing behind to match.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
#: Shortest run that is scored, and log-likelihood ratio (a transition, in nats) that makes it a secret.
MIN_RUN = 20
MIN_RATIO = 0.5
_RUN = f"(?<!{_CLASS}){_CLASS}" + "{%d,}+"
SAMPLE_DOCS = 2000
SEARCH = 100
#: Pseudo-counts of a pair: strong for random strings, whose alphabets differ.
PRIOR = {"random": 20.0, "ordinary": 0.5}


# --- the models -------------------------------------------------------------------------

def _pairs(tokens: Column) -> Column:
    chars = F.split(tokens, "")
    return F.zip_with(F.slice(chars, 1, F.length(tokens) - 1), F.slice(chars, 2, F.length(tokens) - 1),
                      lambda a, b: F.concat(a, b))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random to ordinary) of all character pairs from
    ``samples`` (token, label: random or ordinary), row by row of the
    alphabet.  Characters outside the alphabet and other labels do not count;
    without samples a model is uniform."""
    usable = samples.where(F.col("label").isin(*PRIOR) & F.col("token").rlike(f"^{_CLASS}" + "{2,}$"))
    rows = usable.select("label", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair") \
        .agg(F.count("*").alias("n")).collect()  # at most two rows for each pair of the alphabet
    size = len(ALPHABET)
    counts = {label: [[prior] * size for _ in range(size)] for label, prior in PRIOR.items()}
    for r in rows:
        counts[r["label"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["n"]
    out = []
    for a in range(size):
        sums = {label: sum(counts[label][a]) for label in counts}
        out += [math.log(counts["random"][a][b] / sums["random"]) - math.log(counts["ordinary"][a][b] / sums["ordinary"])
                for b in range(size)]
    return out


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, search: int = SEARCH) -> DataFrame:
    """Tokens labelled by the patterns, from at most ``sample_docs`` documents
    that hold a secret and as many of all documents.  The former are looked for
    among about ``search`` times as many documents; only hashes of (doc_id, text)
    are ordered, and the chosen ones (no more than ``sample_docs``) are
    broadcast.  Null and repeated doc_ids are told apart by their texts; rows
    that repeat both are one document; null texts are left out."""
    some = docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("h"), "text").where(F.col("text").isNotNull())
    apart = some.agg(F.approx_count_distinct("h")).first()[0]
    pool = some
    if apart > sample_docs * search:
        pool = some.where(F.col("h") < int(-(2**63) + 2**64 * (sample_docs * search / apart)))
    secret = F.col("text").rlike(f"{ASSIGN}|{LONG_ACCESS}|{LONG_HEX}")

    def texts(chosen: DataFrame) -> DataFrame:
        return some.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"))

    # the pool is bounded, so what is ordered here is
    held = texts(pool.where(secret).select("h").distinct().orderBy("h").limit(sample_docs))
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), 2), F.regexp_extract_all("text", F.lit(LONG_ACCESS), 0),
                      F.regexp_extract_all("text", F.lit(LONG_HEX), 0))
    random = held.select(F.explode(values).alias("token")).where(F.length("token") >= MIN_LENGTH["assign"]) \
        .withColumn("label", F.lit("random"))
    rest = F.regexp_replace("text", f"{ASSIGN}|{LONG_ACCESS}|{LONG_HEX}", " ")
    ordinary = texts(lowest_values(some.select("h"), sample_docs)) \
        .select(F.explode(F.regexp_extract_all(rest, F.lit(_RUN % 6), F.lit(0))).alias("token")) \
        .withColumn("label", F.lit("ordinary"))
    return random.union(ordinary)


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a run of at least two
    characters of the alphabet."""
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in model) + ")")
    size = len(ALPHABET)
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(token)
    each = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1),
                      lambda a, b: F.element_at(table, ((a - 1) * size + b).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / (n - 1)


# --- spans ---------------------------------------------------------------------------------

def _matches(kind: int, pattern: str) -> Column:
    """Array of (kind, nth, gap, value): what lies between a match and the one
    before it, and the match."""
    text = F.coalesce("text", F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.transform(pairs, lambda p, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), p["gap"].alias("gap"), p["value"].alias("value")))


def find_secrets(docs: DataFrame, model: list[float], min_run: int = MIN_RUN, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored;
    null text: empty): doc_id, content (hash of the text) and spans, sorted by
    start, then kind: (start, kind, end) with the number of the kind in
    ``KINDS`` and code points, the end exclusive.

    Spans of a pattern are its leftmost non-overlapping matches without those
    that are too short; an assignment's span is the whole match.  They always
    stay; of a run that the models call random, the parts that no span of a
    pattern covers are reported, so no character of it is left out.  Null and
    repeated doc_ids are rows like others; an empty table has no rows.  Only
    matches are shuffled, never texts.
    """
    every = F.concat(*(_matches(i, p) for i, p in enumerate((ASSIGN, LONG_ACCESS, LONG_HEX, _RUN % min_run))))
    # numbered below the explode, so that the matches of a row share its number
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("row", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"),
                           F.explode_outer(every).alias("m")) \
        .select("row", "doc_id", "content", "m.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(so_far)) \
        .withColumn("start", F.col("end") - F.length("value"))
    long = F.when(F.col("kind") == 0, F.length(F.regexp_extract("value", ASSIGN, 2)) >= MIN_LENGTH["assign"]) \
        .when(F.col("kind") == 3, ratio(F.col("value"), model) >= min_ratio).otherwise(True)
    rows = rows.withColumn("on", F.col("kind").isNotNull() & long)
    fixed = F.col("on") & (F.col("kind") < 3)
    order = Window.partitionBy("row").orderBy("start", "kind")
    so_far, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("covered", F.max(F.when(fixed, F.col("end"))).over(so_far)) \
        .withColumn("next", F.min(F.when(fixed, F.col("start"))).over(after)) \
        .withColumn("run", F.max(F.when(F.col("on") & (F.col("kind") == 3), F.col("end"))).over(so_far))
    # what is left of a run behind its beginning, or behind a span of a pattern in it, up to the next one
    begin = F.greatest("start", F.coalesce("covered", "start"))
    end = F.least("run", F.coalesce("next", "run"))
    span = F.when(fixed, F.struct("start", "kind", "end"))
    part = F.when(F.col("on") & F.col("run").isNotNull() & (begin < end), F.struct(begin.alias("start"), F.lit(3).alias("kind"), end.alias("end")))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("content").alias("content"),
        F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array(span, part))))).alias("spans")).drop("row")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns (whatever their names), with ``mask`` for
    each secret that ``found`` (of :func:`find_secrets` over the same rows) has;
    spans that overlap or touch become one.  Null texts stay null; rows that
    repeat each other are masked alike.  n_chars, if there, becomes the new
    length."""
    i, content, spans = (unused(x, docs) for x in ("_id", "_content", "_spans"))
    marks = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("content").alias(content),
                                                    F.col("spans").alias(spans)).dropDuplicates([i, content])
    both = docs.join(marks, F.col("doc_id").eqNullSafe(F.col(i)) & (
        F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(content)), "left")

    def step(acc, s):
        apart = (s["start"] > acc["at"]) | ((s["start"] == 0) & (acc["at"] == 0))
        gap = F.when(apart, F.concat(
            F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = both.withColumn("text", F.when(F.col(spans).isNotNull(), done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, train(labelled_samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                        count(3).alias("n_random"))
