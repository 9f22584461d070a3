"""Exact 0-based row index within groups, without a global window.

``Window.partitionBy(group).orderBy(id)`` puts a whole group -- possibly a
third of the corpus -- into one task.  Instead (the classic zipWithIndex
scheme):

1. range-partition by ``(group, order)`` (ties broken by the order key, so
   even one huge group is spread over many partitions) and sort within
   partitions;
2. record each row's position inside its partition;
3. one small aggregate per ``(partition, group)``: first position and count
   (at most partitions + groups rows reach the driver);
4. the driver turns the counts into offsets (rows of the same group in
   earlier partitions) and a broadcast join adds them back.

The positioned table is written to the checkpoint folder, so the aggregate and
the final projection see the same partitioning, also after executors are lost.
Give it keys, not texts, and join the texts by id afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


MAX_BROADCAST_ROWS = 200_000


def group_row_index(df: DataFrame, group_cols: list[str] | None, order_cols: list[str],
                    idx_col: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    group_cols = list(group_cols or [])
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = group_cols + list(order_cols)
    ensure_checkpoint_dir(spark)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("__pos", F.monotonically_increasing_id())
         .withColumn("__pid", F.spark_partition_id())
         .checkpoint())
    stats = (s.groupBy("__pid", *group_cols)
             .agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
             .collect())
    stats.sort(key=lambda r: (tuple((r[g] is None, r[g]) for g in group_cols), r["__pid"]))
    rows, running = [], {}
    for r in stats:
        g = tuple(r[c] for c in group_cols)
        off = running.get(g, 0)
        rows.append([r["__pid"], *g, r["__first"], off])
        running[g] = off + r["__n"]
    dtypes = dict(df.dtypes)
    schema = ", ".join(["__pid int"] + [f"`{g}` {dtypes[g]}" for g in group_cols]
                       + ["__first long", "__off long"])
    offs = spark.createDataFrame(rows, schema)
    # one row per (partition, group), at most partitions + groups: broadcast while that is small
    j = s.join(F.broadcast(offs) if len(rows) <= MAX_BROADCAST_ROWS else offs, on=["__pid", *group_cols], how="inner")
    return j.withColumn(idx_col, F.col("__pos") - F.col("__first") + F.col("__off")) \
        .drop("__pos", "__pid", "__first", "__off")


def group_counts(df: DataFrame, group_cols: list[str]) -> dict:
    """Row count per group (a small dict: one entry per group)."""
    return {tuple(r[g] for g in group_cols): r["n"]
            for r in df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n")).collect()}
