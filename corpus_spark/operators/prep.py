"""Training-sequence tables from encoded documents (``input_ids`` arrays).

All are per-row array expressions (no shuffle) except chunking, which
multiplies rows with ``posexplode``.  Randomness (MLM masking) is a seeded
hash of (document, chunk, position), so results are reproducible and
independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100


def chunk_sequences(df: DataFrame, max_length: int, ids_col: str = "input_ids", id_col: str = "id") -> DataFrame:
    """Split each sequence into consecutive chunks of ``max_length`` (the
    overflow becomes further rows); other document columns are dropped."""
    ids = F.col(ids_col)
    n_chunks = F.greatest(F.ceil(F.size(ids) / F.lit(max_length)), F.lit(1)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1),
                         lambda i: F.slice(ids, i * max_length + 1, F.lit(max_length)))
    return df.select(id_col, F.posexplode(chunks).alias("chunk", ids_col))


def _u(id_col: str, seed: int, tag: str, pos: Column) -> Column:
    """Uniform [0,1) from md5 of (seed, tag, document id, chunk, position)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(id_col).cast("string"),
                      F.col("chunk").cast("string"), pos.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mask_tokens(df: DataFrame, mask_id: int, vocab_size: int, mask_prob: float = 0.15, seed: int = 0,
                special_ids: tuple = (0, 1, 2, 3), ids_col: str = "input_ids", id_col: str = "id") -> DataFrame:
    """Masked-LM inputs/labels: each non-special position is selected with
    ``mask_prob``; selected positions get label = original id and input =
    mask (80 %), a random token (10 %) or unchanged (10 %); other labels
    are -100."""
    ids = F.col(ids_col)
    special = F.array(*[F.lit(s) for s in special_ids])

    def sel(x, i):
        return (_u(id_col, seed, "sel", i) < F.lit(mask_prob)) & ~F.array_contains(special, x)

    labels = F.transform(ids, lambda x, i: F.when(sel(x, i), x).otherwise(F.lit(IGNORE)))

    def new_input(x, i):
        r = _u(id_col, seed, "how", i)
        rnd = (F.lit(len(special_ids)) + F.floor(_u(id_col, seed, "tok", i)
                                                 * F.lit(vocab_size - len(special_ids)))).cast("long")
        return F.when(~sel(x, i), x).when(r < 0.8, F.lit(mask_id).cast("long")).when(r < 0.9, rnd).otherwise(x)

    return df.withColumn("labels", labels).withColumn(ids_col, F.transform(ids, new_input))


def causal_labels(df: DataFrame, pad_id: int = 0, ids_col: str = "input_ids") -> DataFrame:
    """Causal-LM labels: a copy of the inputs with padding set to -100."""
    return df.withColumn("labels", F.transform(ids_col, lambda x: F.when(x == pad_id, F.lit(IGNORE)).otherwise(x)))


def pad_sequences(df: DataFrame, pad_id: int = 0, max_length: int | None = None, multiple_of: int | None = None,
                  ids_col: str = "input_ids") -> DataFrame:
    """Pad to ``max_length`` or up to a multiple of ``multiple_of``; adds
    ``attention_mask``."""
    n = F.size(ids_col)
    if max_length is not None:
        target = F.greatest(F.lit(max_length), n)
    elif multiple_of:
        target = F.ceil(n / F.lit(multiple_of)).cast("int") * F.lit(multiple_of)
    else:
        raise ValueError("max_length or multiple_of is required")
    k = (target - n).cast("int")
    return df.select("*", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id).cast("long"), k)).alias("__p"),
                     F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), k)).alias("attention_mask")) \
        .drop(ids_col).withColumnRenamed("__p", ids_col)


def special_token_frame(df: DataFrame, bos_id: int = 2, eos_id: int = 3, ids_col: str = "input_ids") -> DataFrame:
    """Wrap a sequence in bos/eos; add ``special_tokens_mask`` and segment ids."""
    ids = F.concat(F.array(F.lit(bos_id).cast("long")), F.col(ids_col), F.array(F.lit(eos_id).cast("long")))
    n = F.size(F.col(ids_col))
    return df.withColumn(ids_col, ids).withColumn(
        "special_tokens_mask", F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n), F.array(F.lit(1)))) \
        .withColumn("token_type_ids", F.array_repeat(F.lit(0), n + 2))


def pair_inputs(df: DataFrame, a_col: str, b_col: str | None, bos_id: int = 2, eos_id: int = 3,
                sep_id: int = 3) -> DataFrame:
    """Sentence-pair (premise/hypothesis) or single-text inputs:
    ``bos a sep b eos`` with segment ids 0 for the first part, 1 for the second."""
    bos, eos, sep = (F.array(F.lit(x).cast("long")) for x in (bos_id, eos_id, sep_id))
    a = F.col(a_col)
    if b_col is None:
        return df.withColumn("input_ids", F.concat(bos, a, eos)) \
            .withColumn("token_type_ids", F.array_repeat(F.lit(0), F.size(a) + 2))
    b = F.col(b_col)
    return df.withColumn("input_ids", F.concat(bos, a, sep, b, eos)) \
        .withColumn("token_type_ids", F.concat(F.array_repeat(F.lit(0), F.size(a) + 2),
                                               F.array_repeat(F.lit(1), F.size(b) + 1)))


def align_word_labels(df: DataFrame, word_ids_col: str = "word_ids", tags_col: str = "tags") -> DataFrame:
    """Word tags onto sub-tokens: the first sub-token of each word gets the
    word's tag; later sub-tokens and positions without a word (markers,
    ``word_id < 0``) get -100."""
    wid = F.col(word_ids_col)
    prev = F.concat(F.array(F.lit(-2).cast("long")), F.slice(wid, 1, F.greatest(F.size(wid) - 1, F.lit(0))))
    labels = F.zip_with(wid, prev, lambda w, p: F.when((w < 0) | (w == p), F.lit(IGNORE))
                        .otherwise(F.element_at(F.col(tags_col), (w + 1).cast("int"))))
    return df.withColumn("labels", labels)


def align_dependency_labels(df: DataFrame, max_length: int, word_ids_col: str = "word_ids",
                            heads_col: str = "head", rels_col: str = "deprel_ids") -> DataFrame:
    """Dependency heads/relations on the first sub-token of each word
    (-100 elsewhere) plus the word-start positions, padded with -100 to
    ``max_length + 1``.  Sub-tokens behind ``max_length`` are cut off from the
    sequence, so labels and word starts are those of the same sub-tokens."""
    wid = F.slice(F.col(word_ids_col), 1, max_length)
    prev = F.concat(F.array(F.lit(-2).cast("long")), F.slice(wid, 1, F.greatest(F.size(wid) - 1, F.lit(0))))
    first = F.zip_with(wid, prev, lambda w, p: (w >= 0) & (w != p))
    heads = F.zip_with(wid, first, lambda w, f: F.when(f, F.element_at(F.col(heads_col), (w + 1).cast("int")))
                       .otherwise(F.lit(IGNORE)))
    rels = F.zip_with(wid, first, lambda w, f: F.when(f, F.element_at(F.col(rels_col), (w + 1).cast("int")))
                      .otherwise(F.lit(IGNORE)))
    starts = F.filter(F.transform(first, lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda x: x >= 0)
    starts = F.concat(starts, F.array_repeat(F.lit(IGNORE), F.lit(max_length + 1) - F.size(starts)))
    return df.withColumn("labels_head", heads).withColumn("labels_rel", rels).withColumn("word_starts", starts)
