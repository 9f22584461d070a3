"""Exact and near-duplicate removal.

* exact: md5 of the tokens concatenated without a separator (so it ignores
  white space); the first document (smallest id) of every hash survives.
* near: MinHash signatures over distinct token n-gram shingles, LSH bands as
  equi-join keys, and the reference's *greedy* rule: walking documents in id
  order, a document is dropped when it shares a band bucket with an earlier
  document that was **kept**.  That is the lexicographically-first maximal
  independent set of the bucket graph, computed here as a fixpoint over a
  ``(id, bucket)`` table -- never as pairs of documents, so a bucket holding a
  third of the corpus costs the same as any other (one partial aggregate).

Only ``(id, hash)`` / ``(id, bucket)`` projections are shuffled; the text
itself is never shuffled for deduplication (the final anti join against the
duplicate ids is sized by AQE at run time).
"""

from __future__ import annotations

import functools
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_ngrams
from ..session import ensure_checkpoint_dir, written
from .candidate_pairs import bucket_places, pair_similarities
from .metrics import with_tokens

# ---------------------------------------------------------------------------
# Fixed parameters of our MinHash family (ours, not the reference's)
# ---------------------------------------------------------------------------
NUM_PERM = 64
PRIME = (1 << 31) - 1          # Mersenne prime 2^31 - 1
EMPTY_SENTINEL = PRIME         # value no real permutation can produce
PERM_SEED = 20240607


def _splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = x
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return z ^ (z >> 31)


def permutations(num_perm: int = NUM_PERM, seed: int = PERM_SEED) -> list[tuple[int, int]]:
    """(a_i, b_i) with 0 < a_i < p and 0 <= b_i < p, generated by a fixed rule."""
    out, s = [], seed
    for _ in range(num_perm):
        s = _splitmix64(s)
        a = 1 + s % (PRIME - 1)
        s = _splitmix64(s)
        b = s % PRIME
        out.append((a, b))
    return out


PERMS = permutations()


def shingle_hex(shingle: Column) -> Column:
    """32-bit hash of a shingle: the first 8 hex digits of its md5."""
    return F.substring(F.md5(shingle), 1, 8)


def shingle_hash(shingle: Column) -> Column:
    """:func:`shingle_hex` as a number."""
    return F.conv(shingle_hex(shingle), 16, 10).cast("long")


def exact_hash(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, ""))


def shingles(tokens: Column, n: int) -> Column:
    return F.array_distinct(word_ngrams(tokens, n))


@functools.lru_cache(maxsize=None)
def optimal_bands(threshold: float, num_perm: int = NUM_PERM,
                  fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) minimising the weighted false-positive and false-negative
    areas of the LSH S-curve (the standard published rule)."""
    import numpy as np

    def area(f, a, b):
        xs = np.linspace(a, b, 2001)
        ys = f(xs)
        return float(((ys[1:] + ys[:-1]) * 0.5 * np.diff(xs)).sum())

    best, best_err = (1, 1), float("inf")
    for b in range(1, num_perm + 1):
        max_r = num_perm // b
        for r in range(1, max_r + 1):
            fp = area(lambda s: 1 - (1 - s ** r) ** b, 0.0, threshold)
            fn = area(lambda s: 1 - (1 - (1 - s ** r) ** b), threshold, 1.0)
            err = fp * fp_weight + fn * fn_weight
            if err < best_err:
                best, best_err = (b, r), err
    return best


def minhash_signatures(df: DataFrame, n_shingles: int = 1, id_col: str = "id",
                       text_col: str = "text", tokenizer=None) -> DataFrame:
    """``(id, sig ARRAY<BIGINT>[64])``, inside the scan: a row's shingle hashes
    are one binary value, four bytes each (native), whose minima under all
    permutations numpy takes, a slice of a batch at a time; nothing is shuffled.  Documents
    without a shingle get the all-sentinel signature, so they all collide with
    each other (as in the reference, where an empty MinHash equals every other
    empty one)."""
    df = with_tokens(df.select(id_col, text_col) if "tokens" not in df.columns
                     else df.select(id_col, "tokens"), text_col, tokenizer)
    # duplicates do not change a minimum, so shingles are not de-duplicated here
    hashes = F.transform(word_ngrams(F.col("tokens"), n_shingles), shingle_hex)
    hashed = df.select(F.col(id_col).alias("id"), F.unhex(F.array_join(hashes, "")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            for at, to in _batch_pieces(sizes):
                raw = b"".join(x for x in batch.column(1).slice(at, to - at).to_pylist() if x is not None)
                sig = permutation_minima(np.frombuffer(raw, ">u4").astype(np.uint64), sizes[at:to])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, NUM_PERM, dtype=np.int32)),
                                                pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), rows], names=["id", "sig"])

    return hashed.mapInArrow(run, T.StructType([T.StructField("id", hashed.schema["id"].dataType),
                                                T.StructField("sig", T.ArrayType(T.LongType()))]))


#: Shingle hashes worked off at a time: few enough to stay in a core's cache.
PIECE_HASHES = 1 << 14


def _batch_pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows ``[at, to)`` with about ``PIECE_HASHES`` hashes together (or one longer row)."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_HASHES, side="right")))
        yield at, to
        at = to


def permutation_minima(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row (``lengths``: its number of 32-bit ``hashes``, which stand
    on end) the minimum of ``(a * h + b) % PRIME`` for every permutation; the
    sentinel for a row without a hash."""
    out = np.full((len(lengths), NUM_PERM), EMPTY_SENTINEL, np.int64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    starts = (np.cumsum(lengths) - lengths)[some]
    low, shift = np.uint64(PRIME), np.uint64(31)
    x, high = np.empty_like(hashes), np.empty_like(hashes)
    for i, (a, b) in enumerate(PERMS):
        np.multiply(hashes, np.uint64(a), out=x)
        x += np.uint64(b)  # below 2**63
        for _ in range(2):  # 2**31 is 1 modulo the prime
            np.right_shift(x, shift, out=high)
            x &= low
            x += high
        np.subtract(x, low, out=high)  # a very large number where x is below the prime
        np.minimum(x, high, out=x)
        out[some, i] = np.minimum.reduceat(x, starts)
    return out


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """One md5 key per band (array of ``bands`` strings)."""
    return F.array(*[F.md5(F.array_join(F.slice(sig, j * rows + 1, rows).cast("array<string>"), ","))
                     for j in range(bands)])


def lsh_buckets(sigs: DataFrame, threshold: float) -> DataFrame:
    """``(id, band INT, bkey STRING)`` -- one row per document and band."""
    b, r = optimal_bands(threshold)
    return sigs.select("id", F.posexplode(band_keys(F.col("sig"), b, r)).alias("band", "bkey"))


def lsh_candidates(buckets: DataFrame) -> DataFrame:
    """Per document: the smallest *other* id it shares a band bucket with
    (``first_candidate``, NULL if none) and how many of its buckets are shared.

    This is what an LSH index query returns for the document, reduced to a
    linear-size answer: per bucket only the two smallest ids are kept, so no
    pair list is ever built, however large a bucket is.  Buckets of one document
    are left out before anything is joined back, and what is known of very large
    ones comes back by broadcast, so their rows stay spread by id."""
    ensure_checkpoint_dir(buckets.sparkSession)
    rows = _numbered(buckets).checkpoint(eager=True)
    shared = _shared_buckets(rows, HOT_BUCKET).checkpoint(eager=True)
    least = shared.groupBy("bucket", "hot").agg(F.min("id").alias("m1"))
    first = _bucket_join(shared, least.withColumn("h", F.col("hot"))).withColumnRenamed("h", "hot").checkpoint(eager=True)
    second = first.filter(F.col("id") > F.col("m1")).groupBy("bucket", "hot").agg(F.min("id").alias("m2"))
    other = F.when(F.col("id") == F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    met = _bucket_join(first, second).groupBy("id").agg(F.min(other).alias("first_candidate"),
                                                        F.count(F.lit(1)).alias("shared_buckets"))
    return rows.select("id").distinct().join(met, "id", "left").select(
        "id", "first_candidate", F.coalesce("shared_buckets", F.lit(0)).cast("long").alias("shared_buckets"))


def jaccard_verify(df: DataFrame, buckets: DataFrame, n_shingles: int = 1, id_col: str = "id", text_col: str = "text",
                   tokenizer=None) -> DataFrame:
    """Exact Jaccard similarity of all pairs of documents that share a band
    bucket: ``(id, candidate, jaccard)``, ``id < candidate``, each pair once.

    :func:`lsh_candidates` tells which documents have a partner at all; shingles
    (64-bit hashes) are made for these only.  Two empty sets have similarity 1.
    Rows that share an id are candidates together, and compared each by its own
    text; rows without an id have no partner."""
    buckets = written(_numbered(buckets), "lsh-buckets")
    met = lsh_candidates(buckets).filter(F.col("first_candidate").isNotNull()).select("id")
    own = buckets.join(met, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    src = df.select(F.col(id_col).alias("id"), "tokens" if "tokens" in df.columns else text_col)
    chars = F.size("tokens") if "tokens" in df.columns else F.length(text_col)
    members = src.select("id", F.coalesce(chars, F.lit(0)).alias("chars")).join(own, "id")
    places = written(bucket_places(written(members, "candidate-members")), "candidate-places")
    hashes = F.array_distinct(F.transform(word_ngrams(F.col("tokens"), n_shingles), lambda x: F.xxhash64(x)))
    sets = with_tokens(src.join(places, "id"), text_col, tokenizer).select(
        "id", "buckets", "places", F.coalesce(hashes, F.array().cast("array<bigint>")).alias("hashes"))
    return pair_similarities(sets)


#: Buckets of more documents are joined by broadcast: there are at most
#: (rows / HOT_BUCKET) of them, so their number is bounded.
HOT_BUCKET = 50_000


def _numbered(buckets: DataFrame) -> DataFrame:
    """``(id, bucket)`` with one 64-bit number for band and key."""
    if "bucket" in buckets.columns:
        return buckets.select("id", "bucket")
    return buckets.select("id", F.xxhash64("band", "bkey").alias("bucket"))


def _shared_buckets(buckets: DataFrame, hot_bucket: int) -> DataFrame:
    """``(id, bucket, hot)`` of the buckets with at least two documents (the
    others never matter)."""
    rows = _numbered(buckets)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    sizes = sizes.select("bucket", (F.col("n") > hot_bucket).alias("hot"))
    hot = rows.join(F.broadcast(sizes.filter("hot")), "bucket")
    return rows.join(sizes.filter("not hot"), "bucket").unionByName(hot)


def _bucket_join(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """``rows`` (bucket, hot, ...) with what ``per_bucket`` has for the bucket;
    of very large buckets it comes by broadcast, so their rows stay where they are."""
    return rows.filter("hot").drop("hot").join(F.broadcast(per_bucket.filter("hot").drop("hot")), "bucket") \
        .unionByName(rows.filter("not hot").drop("hot").join(per_bucket.filter("not hot").drop("hot"), "bucket"))


def bucket_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(id, comp)``: the smallest id that each one of ``edges`` (id, bucket,
    hot) reaches over shared buckets.  Each round takes the least label of all
    buckets and then that id's own label, so a chain takes as many rounds as
    its length has binary digits, or a few more."""
    labels = edges.select("id").distinct().withColumn("comp", F.col("id")).checkpoint(eager=True)
    for _ in range(max_rounds):
        low = edges.join(labels, "id").groupBy("bucket", "hot").agg(F.min("comp").alias("low"))
        near = _bucket_join(edges, low).groupBy("id").agg(F.min("low").alias("near"))
        far = near.join(near.select(F.col("id").alias("near"), F.col("near").alias("far")), "near")
        new = labels.join(far, "id").select("id", F.col("far").alias("comp"), (F.col("far") < F.col("comp")).alias("moved")) \
            .checkpoint(eager=True)
        labels = new.select("id", "comp")
        if new.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def _walk_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy rule on rows (comp, id, st, bucket) sorted by comp and id:
    the decisions (id, now) on undecided documents.  A component's claimed
    buckets are all that is held."""
    comp = doc = None
    claimed: set[int] = set()
    own: list[int] = []
    state = 0
    out: list[tuple[int, int]] = []

    def decide() -> None:
        drop = state == 0 and not claimed.isdisjoint(own)
        if not drop:
            claimed.update(own)
        if state == 0:
            out.append((doc, 2 if drop else 1))

    def emit(kind: pa.DataType) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], kind), pa.array([n for _, n in out], pa.int32())],
                                          names=["id", "now"])
        out.clear()
        return rows

    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        for c, i, st, bucket in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if c != comp or i != doc:
                if doc is not None:
                    decide()
                if c != comp:
                    claimed.clear()
                comp, doc, state, own = c, i, st, []
            own.append(bucket)
        yield emit(kind)
    if doc is not None:
        decide()
        yield emit(kind)


#: Rounds before what is left is looked at by component, and rows (document
#: and bucket) of a component that is walked through within one task.
FAST_ROUNDS = 4
LOCAL_ROWS = 200_000


def greedy_keep(buckets: DataFrame, max_rounds: int = 10_000, hot_bucket: int = HOT_BUCKET, fast_rounds: int = FAST_ROUNDS,
                local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Ids dropped by the sequential greedy rule, as a DataFrame ``(id)``.

    Fixpoint over document states: undecided, kept, dropped.  Each round, per
    bucket: smallest id that is not dropped, and smallest kept id; an undecided
    document is dropped when some bucket has a smaller kept id, and kept when
    it is the smallest remaining id of all its buckets.  The smallest undecided
    document is always decided, so the fixpoint ends.

    A round decides one link of a chain.  Most documents are decided in
    ``fast_rounds``; then the components of those that are not are found in
    logarithmically many rounds, and each component of at most ``local_rows``
    rows is walked through in id order within a task, however long its chains.
    Only larger components take more rounds.

    ``(id, bucket)`` is written once, spread by id; a round writes the states.
    Bucket minima are partial aggregates (one row per bucket and task), and
    the minima of very large buckets come back by broadcast, so no bucket is
    ever in one task.
    """
    ensure_checkpoint_dir(buckets.sparkSession)
    edges = _shared_buckets(buckets, hot_bucket).checkpoint(eager=True)
    state = edges.select("id").distinct().select("id", F.lit(0).alias("st"))
    for done in range(1, max_rounds + 1):
        live = edges.join(state.filter("st <> 2"), "id")
        low = live.groupBy("bucket", "hot").agg(F.min("id").alias("m_nd"),
                                                F.min(F.when(F.col("st") == 1, F.col("id"))).alias("m_k"))
        met = _bucket_join(live.filter("st = 0"), low)
        decided = met.groupBy("id").agg(
            F.max(F.coalesce(F.col("m_k") < F.col("id"), F.lit(False))).alias("drop"),
            F.min(F.col("m_nd") == F.col("id")).alias("keep"))
        state = state.join(decided, "id", "left").select(
            "id", F.when(F.col("st") != 0, F.col("st")).when(F.col("drop"), 2).when(F.col("keep"), 1)
            .otherwise(0).alias("st")).checkpoint(eager=True)
        if state.filter("st = 0").isEmpty():
            return state.filter("st = 2").select("id")
        if done == fast_rounds:
            state = _decide_locally(edges, state, local_rows)
            if state.filter("st = 0").isEmpty():
                return state.filter("st = 2").select("id")
    raise RuntimeError(f"greedy dedup did not converge in {max_rounds} rounds")


def _decide_locally(edges: DataFrame, state: DataFrame, local_rows: int) -> DataFrame:
    """``state`` with the documents of all components of at most
    ``local_rows`` rows decided.  Components are those of the undecided
    documents; kept ones that share a bucket with them are kept ones of the
    bucket's component (no undecided document comes before them)."""
    live = edges.join(state.filter("st <> 2"), "id")
    open_ = live.filter("st = 0").select("id", "bucket", "hot").checkpoint(eager=True)
    comps = bucket_components(open_)
    of_bucket = open_.join(comps, "id").groupBy("bucket", "hot").agg(F.min("comp").alias("comp"))
    rows = _bucket_join(live, of_bucket).select("comp", "id", "st", "bucket").checkpoint(eager=True)
    small = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= local_rows).select("comp")
    sorted_ = rows.join(small, "comp").repartition("comp").sortWithinPartitions("comp", "id")
    decided = sorted_.mapInArrow(_walk_components, T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("now", T.IntegerType())]))
    return state.join(decided, "id", "left").select("id", F.coalesce("now", "st").alias("st")).checkpoint(eager=True)


HASH_COL = "exact_hash"


def with_exact_hash(df: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer=None) -> DataFrame:
    """``(id, exact_hash)``, from an ``exact_hash`` column when there is one."""
    if HASH_COL in df.columns:
        return df.select(id_col, HASH_COL)
    src = df.select(id_col, "tokens") if "tokens" in df.columns else df.select(id_col, text_col)
    return with_tokens(src, text_col, tokenizer).select(id_col, exact_hash(F.col("tokens")).alias(HASH_COL))


def first_of_each_hash(df: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer=None) -> DataFrame:
    """The rows whose id is the smallest of their exact hash (a row without a
    hash is a first of its own).  One map-side combined aggregate on the hash,
    which a very common text does not skew, and one semi join on the id."""
    h = with_exact_hash(df, id_col, text_col, tokenizer)
    key = F.coalesce(F.col(HASH_COL), F.concat(F.lit("id "), F.col(id_col).cast("string")))
    firsts = h.groupBy(key.alias("__hash")).agg(F.min(id_col).alias(id_col))
    return df.join(firsts.select(id_col), on=id_col, how="left_semi")


dedup_exact = first_of_each_hash


def near_duplicate_ids(df: DataFrame, jaccard_threshold: float = 0.85, n_shingles: int = 1,
                       id_col: str = "id", text_col: str = "text", tokenizer=None) -> DataFrame:
    sigs = minhash_signatures(df, n_shingles, id_col, text_col, tokenizer)
    ensure_checkpoint_dir(df.sparkSession)
    return greedy_keep(_numbered(lsh_buckets(sigs, jaccard_threshold)).checkpoint(eager=True))


def deduplicate(df: DataFrame, exact_match: bool = False, min_hash: bool = False,
                jaccard_threshold: float = 0.85, n_shingles: int = 1, id_col: str = "id",
                text_col: str = "text", tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Exact and/or MinHash-LSH deduplication with the reference's interaction:
    the MinHash pass runs over *all* documents (an exact duplicate still
    claims its buckets when nothing earlier collides), and a document survives
    when it passes both tests."""
    if not (exact_match or min_hash):
        raise ValueError("deduplicate: switch exact_match or min_hash on")
    if df.isStreaming:
        raise ValueError("deduplicate() needs the whole table; use streaming.stream_dedup_exact")
    out = first_of_each_hash(df, id_col, text_col, tokenizer) if exact_match else df
    if min_hash:
        near = near_duplicate_ids(df, jaccard_threshold, n_shingles, id_col, text_col, tokenizer)
        out = out.join(near.withColumnRenamed("id", id_col), on=id_col, how="left_anti")
    return out
