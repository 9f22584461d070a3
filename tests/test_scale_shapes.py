"""Inputs of the shapes that large corpora have: very many languages, one
bucket with a third of all rows."""

import random

from pyspark.sql import functions as F

from corpus_spark.operators import dedup, sampling


def test_sampling_of_1500_languages(spark):
    langs = [f"l{i:04d}" for i in range(1500)]
    rnd = random.Random(1)
    weights = [rnd.random() for _ in langs]
    probs = [w / sum(weights) for w in weights]
    got = {r.t: r.language for r in sampling._draws(spark, 4000, langs, probs, 3).collect()}
    assert set(got) == set(range(4000))
    import hashlib
    for t in range(0, 4000, 7):
        u = int(hashlib.md5(f"draw3:{t}".encode()).hexdigest()[:13], 16) / 2**52
        acc, want = 0.0, langs[-1]
        for lang, p in zip(langs, probs):
            acc += p
            if u < acc:
                want = lang
                break
        assert got[t] == want


def test_every_row_of_many_languages_is_sampled(spark):
    df = spark.range(0, 700).withColumn("language", F.concat(F.lit("l"), F.col("id").cast("string")))
    out = sampling.apply_language_sampling(df, "uniform", interleaving_strategy="all_exhausted")
    assert out.select("id").distinct().count() == 700


def greedy(edges):
    by = {}
    for i, b in edges:
        by.setdefault(i, set()).add(b)
    kept, dropped = set(), set()
    for i in sorted(by):
        if by[i] & kept:
            dropped.add(i)
        else:
            kept |= by[i]
    return dropped


def test_hot_bucket_is_spread(spark):
    rnd = random.Random(2)
    edges = [(i, f"b{rnd.randrange(2000)}") for i in range(3000) for _ in range(2)] + [(i, "hot") for i in range(1, 3000, 3)]
    rows = spark.createDataFrame([(i, 0, b) for i, b in edges], "id long, band int, bkey string").distinct()
    got = {r.id for r in dedup.greedy_keep(rows, hot_bucket=100).collect()}
    assert got == greedy(edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are too few to stay apart
    try:
        shared = dedup._shared_buckets(rows.repartition(8, "id"), 100)
        hot = shared.filter("hot").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in hot) == 1000 and max(r["count"] for r in hot) < 800
