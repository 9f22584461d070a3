"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each gets what its predecessor kept, written
as Parquet and read again, so a lost executor costs tasks of one stage.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import gam, line_quality, near_dup, packing, secret_scan
from corpus_spark.llm.common import documents, materialize


#: Words of a shingle, and similarity in percent, that make near duplicates.
SHINGLE_WORDS = 5
SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their words when
    lines above the limits of their host are removed; those lines are gone.

    Null and empty texts have no words and are rejected; a text of any length
    is judged whole.  A null source is a host of its own.  Of the documents
    that share a frequent line the first by doc_id (null first), then by text
    keeps it; rows that repeat each other are judged alike.  An empty table
    stays empty.  Other columns, whatever their names, stay as they are, but
    n_chars becomes the new length."""
    return line_quality.remove_lines(docs, line_quality.quality_rules(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted to labelled documents of the
    stage's input that are not held out, takes for good ones.

    Null texts count as empty; a text of any length is scored whole.  Rows with
    equal texts get equal scores, a score of just 0.5 is kept.  Labels of null
    doc_ids, and null labels, are not learned from; without any label every
    document scores 0.5 and is kept.  An empty table stays empty; all columns
    stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gam.keep_good(docs, gam.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near
    duplicates (five-word shingles, similarity 0.8 or more).

    Null, empty and blank texts are duplicates of nothing and stay; a text of
    fewer words than a shingle is one shingle; texts of any length are compared
    whole.  A null doc_id is smaller than all others; of rows that share the
    smallest doc_id those of one text leave one row.  An empty table stays
    empty; all columns, whatever their names, stay as they are."""
    found = near_dup.near_duplicates(docs, words=SHINGLE_WORDS, percent=SIMILARITY, content=True)
    return near_dup.drop_near_duplicates(docs, found)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret.

    Null texts stay null, empty ones empty; texts of any length are searched
    whole.  Null and repeated doc_ids are rows like others, rows that repeat
    each other are masked alike.  An empty table stays empty.  Other columns,
    whatever their names, stay as they are, but n_chars becomes the new
    length."""
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    return secret_scan.redact(docs, secret_scan.find_secrets(docs, model))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts have the end id alone; a text of any length is cut
    into pieces of at most 4096 ids.  Null and repeated doc_ids are documents of
    their own; pieces of equal length are placed in the order in which tasks
    meet them.  An empty table has no pieces; other columns are ignored."""
    import public_tokenizers
    _, placed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scan_stage),
    ("packing", pack),
]

#: SQL cannot express the classifier, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
