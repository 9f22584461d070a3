"""Structured Streaming versions of the operators whose semantics are
per-document (or keep bounded state): pre-filter, fixed thresholds, exact
dedup and per-language counts.  Global decisions (auto thresholds, quality
halves, MinHash greedy order) refuse streams with ``ValueError``.

Every helper returns a streaming DataFrame; :func:`run_available_now`
drives one to completion into a sink under the session's checkpoint
directory (shared storage on a cluster) and returns the written table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, threshold as thr
from ..operators.dedup import exact_hash
from ..operators.metrics import with_tokens
from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, directory: str, file_glob: str, schema,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ``directory`` matching ``file_glob`` as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def read_table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet table ``path``, one file or a folder of files, as a stream.
    Spark takes a single file as the source of a stream only by a pattern, so
    the path's last letter is given as one."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def run_available_now(sdf: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process everything available, write it to parquet, return the table.
    ``complete``-mode aggregates are written per micro-batch with overwrite."""
    spark = sdf.sparkSession
    out = scratch_path(spark, name)
    ckpt = out + "-ckpt"
    w = sdf.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        def sink(batch: DataFrame, epoch: int):
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode(output_mode).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_pre_filter(sdf: DataFrame, scripts=None, c4: bool = False) -> DataFrame:
    """Stateless line cleaning, the same Column functions as the batch pre-filter."""
    return clean.pre_filter(sdf, scripts=scripts, c4=c4)


def stream_threshold(sdf: DataFrame, thresholds: dict, keep_columns: bool = False) -> DataFrame:
    """Fixed thresholds only ("auto" needs the whole table)."""
    if any(v == "auto" for v in thresholds.values()):
        raise ValueError("auto thresholds need the whole table; not available on a stream")
    return thr.apply_threshold(sdf, thresholds, keep_columns=keep_columns)


def stream_dedup_exact(sdf: DataFrame, event_time: str | None = None, watermark: str = "1 day") -> DataFrame:
    """First document per exact hash.  With an event-time column the state is
    bounded by the watermark (``dropDuplicatesWithinWatermark``); without one
    the hash set grows with the stream.  :func:`dedup_exact_to_table` needs no
    state and no event time."""
    h = with_tokens(sdf).withColumn("exact_hash", exact_hash(F.col("tokens"))).drop("tokens")
    if event_time:
        return h.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["exact_hash"])
    return h.dropDuplicates(["exact_hash"])


def dedup_exact_to_table(sdf: DataFrame, path: str) -> DataFrame:
    """Append the first document of each exact hash to the table in ``path``
    and return the table (with its column ``exact_hash``).

    There is no streaming state: a micro-batch is joined against the hashes
    already in the table, of which only that column is read, and both sides are
    spread by the hash.  What a batch adds is a partition of its own that is
    overwritten when the batch is replayed, and a batch looks only at batches
    before it, so a restart neither loses nor repeats a document.  The query's
    checkpoint is kept beside the table: called again with the same path and a
    stream over the same source, it goes on where it stopped.

    Documents are equal if their tokens put together are; null texts are equal
    to each other only.  Of equal ones in one batch any one is kept, of batches
    the first.  An input without rows gives an empty table."""
    spark = sdf.sparkSession
    hashed = with_tokens(sdf).withColumn("exact_hash", exact_hash(F.col("tokens"))).drop("tokens")
    schema = T.StructType([*hashed.schema.fields, T.StructField("__batch", T.LongType())])
    spark.createDataFrame([], hashed.schema).write.mode("ignore").parquet(f"{path}/__batch=-1")

    def sink(batch: DataFrame, epoch: int):
        known = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("__batch") < epoch).select("exact_hash")
        (batch.join(known, batch["exact_hash"].eqNullSafe(known["exact_hash"]), "left_anti").dropDuplicates(["exact_hash"]).select(*hashed.columns)
         .write.mode("overwrite").parquet(f"{path}/__batch={epoch}"))

    hashed.writeStream.option("checkpointLocation", f"{path}-ckpt").trigger(availableNow=True) \
        .foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(schema).parquet(path).drop("__batch")


def stream_corpus_stats(sdf: DataFrame, language_col: str = "language") -> DataFrame:
    """Running documents and characters per language (complete output mode)."""
    return sdf.groupBy(language_col).agg(F.count(F.lit(1)).cast("long").alias("docs"),
                                         F.sum(F.length("text")).cast("long").alias("chars"))


def to_table(sdf: DataFrame, name: str = "to_table") -> DataFrame:
    """Materialise a stream as a regular table (availableNow, parquet)."""
    return run_available_now(sdf, name)


def to_stream(df: DataFrame, name: str = "to_stream") -> DataFrame:
    """Write a table as parquet files and reopen them as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)
