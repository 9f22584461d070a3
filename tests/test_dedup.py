"""Greedy MinHash-LSH dedup against a sequential oracle of ours."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import dedup


def sequential_greedy(pairs):
    """pairs: (id, bucket). Walk ids ascending; keep a doc unless one of its
    buckets already holds a kept doc."""
    by_id = {}
    for i, b in pairs:
        by_id.setdefault(i, set()).add(b)
    kept_buckets, dropped = set(), set()
    for i in sorted(by_id):
        if by_id[i] & kept_buckets:
            dropped.add(i)
        else:
            kept_buckets |= by_id[i]
    return dropped


def run_greedy(spark, pairs):
    df = spark.createDataFrame([(i, 0, str(b)) for i, b in pairs], "id long, band int, bkey string")
    return {r.id for r in dedup.greedy_keep(df).collect()}


def test_chain_keeps_a_and_c(spark):
    # A~B, B~C, A!~C: greedy keeps A and C (not connected components)
    pairs = [(1, "x"), (2, "x"), (2, "y"), (3, "y")]
    assert run_greedy(spark, pairs) == {2}


@pytest.mark.parametrize("seed", range(6))
def test_random_bucket_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(20, 80)
    nb = rnd.randint(5, 40)
    pairs = set()
    for i in range(n):
        for _ in range(rnd.randint(1, 3)):
            pairs.add((i, rnd.randrange(nb)))
    # one hot bucket holding a third of the documents
    for i in rnd.sample(range(n), n // 3):
        pairs.add((i, "hot"))
    pairs = sorted(pairs, key=lambda p: (p[0], str(p[1])))
    assert run_greedy(spark, pairs) == sequential_greedy(pairs)


@pytest.mark.parametrize("local_rows", [0, 6, 10**6])
def test_components_are_walked_or_go_on_in_rounds(spark, local_rows):
    """Chains, stars and a hot bucket, with few fast rounds, so that small components are walked and others are not."""
    rnd = random.Random(local_rows)
    pairs = set()
    for c in range(25):
        n = rnd.randint(2, 9)
        ids = rnd.sample(range(c * 100, c * 100 + 99), n)
        for i, (a, b) in enumerate(zip(ids, ids[1:])):
            pairs |= {(a, f"c{c}.{i}"), (b, f"c{c}.{i}")}
    pairs |= {(i, "hot") for i in rnd.sample(range(2500), 60)}
    df = spark.createDataFrame([(i, 0, b) for i, b in pairs], "id long, band int, bkey string")
    got = {r.id for r in dedup.greedy_keep(df, hot_bucket=40, fast_rounds=1, local_rows=local_rows).collect()}
    assert got == sequential_greedy(sorted(pairs))


def test_components(spark):
    edges = [(1, 10), (2, 10), (2, 11), (3, 11), (7, 12), (9, 12), (9, 13), (8, 13)] + [(100 + i, 50 + i // 2) for i in range(64)]
    edges += [(100 + i, 50 + (i - 1) // 2) for i in range(2, 64, 2)]
    df = spark.createDataFrame([(i, b, b == 12) for i, b in edges], "id long, bucket long, hot boolean")
    got = {r.id: r.comp for r in dedup.bucket_components(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert {got[100 + i] for i in range(64)} == {100}


def test_chain_of_ten_thousand(spark):
    """Jobs grow with the digits of the chain's length, not with its length."""
    n = 10_000
    links = spark.range(n)
    pairs = links.selectExpr("id", "0 AS band", "string(id) AS bkey").union(links.selectExpr("id + 1 AS id", "0", "string(id)"))
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        dropped = {r.id for r in dedup.greedy_keep(pairs).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    print("jobs", jobs)
    assert dropped == set(range(1, n + 1, 2)) and jobs < 600


def test_long_chain(spark):
    pairs = []
    for i in range(12):
        pairs += [(i, f"b{i}"), (i + 1, f"b{i}")]
    assert run_greedy(spark, pairs) == sequential_greedy(pairs)


def test_dedup_matches_sequential_on_documents(spark):
    from corpus_spark.sources.tables import read_documents
    docs = read_documents(spark, "/root/testdata/sf0.001")
    sigs = dedup.minhash_signatures(docs, n_shingles=3)
    buckets = dedup.lsh_buckets(sigs, 0.8)
    pairs = [(r.id, (r.band, r.bkey)) for r in buckets.collect()]
    expected = sequential_greedy(pairs)
    got = {r.id for r in dedup.greedy_keep(buckets).collect()}
    assert got == expected
    assert len(expected) > 0


def test_exact_and_minhash_interaction(spark):
    # doc 1 is an exact duplicate of doc 0 ("a b" vs "ab") but still claims
    # its MinHash buckets; the reference's loop behaves the same way.
    df = spark.createDataFrame([(0, "a b c d"), (1, "abcd"), (2, "x y z w")], "id long, text string")
    out = {r.id for r in dedup.deduplicate(df, exact_match=True, min_hash=True).collect()}
    assert out == {0, 2}


def test_empty_shingle_docs_collide(spark):
    df = spark.createDataFrame([(0, "one two"), (1, "three"), (2, "alpha beta gamma delta")],
                               "id long, text string")
    out = {r.id for r in dedup.deduplicate(df, min_hash=True, n_shingles=3).collect()}
    assert out == {0, 2}


def test_band_choice():
    assert dedup.optimal_bands(0.8) == (5, 11)
    assert dedup.optimal_bands(0.85) == (4, 15)


def test_needs_a_method(spark):
    df = spark.createDataFrame([(0, "a")], "id long, text string")
    with pytest.raises(ValueError):
        dedup.deduplicate(df)


@pytest.mark.parametrize("seed", range(3))
def test_lsh_candidates_brute_force(spark, seed):
    rnd = random.Random(100 + seed)
    n = 60
    pairs = set()
    for i in range(n):
        for band in range(3):
            pairs.add((i, band, f"k{rnd.randrange(12)}"))
    for i in rnd.sample(range(n), n // 3):      # a hot bucket with a third of the documents
        pairs.add((i, 0, "hot"))
    df = spark.createDataFrame(sorted(pairs), "id long, band int, bkey string")
    got = {r.id: (r.first_candidate, r.shared_buckets) for r in dedup.lsh_candidates(df).collect()}
    members = {}
    for i, b, k in pairs:
        members.setdefault((b, k), set()).add(i)
    for i in range(n):
        mine = [(b, k) for (j, b, k) in pairs if j == i]
        others = set().union(*[members[m] - {i} for m in mine])
        shared = sum(1 for m in mine if len(members[m]) >= 2)
        assert got[i] == (min(others) if others else None, shared)


def test_signatures_equal_plain_loops_and_stay_in_the_scan(spark):
    import hashlib
    texts = ["one two three two three four", "", "a", None, "one two three " * 50, "x y z", "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for n in (1, 3):
        sigs = dedup.minhash_signatures(df, n)
        assert "Exchange" not in sigs._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.sig for r in sigs.collect()}
        for i, t in enumerate(texts):
            w = (t or "").split()
            grams = [" ".join(w[j:j + n]) for j in range(len(w) - n + 1)]
            hs = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
            assert got[i] == [min(((a * h + b) % dedup.PRIME for h in hs), default=dedup.EMPTY_SENTINEL)
                              for a, b in dedup.PERMS]


def test_permutation_minima_in_small_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 7}" for j in range(i))) for i in range(40)], "id long, text string")
    want = sorted(map(tuple, dedup.minhash_signatures(df, 2).collect()))
    monkeypatch.setattr(dedup, "PIECE_HASHES", 3)
    assert sorted(map(tuple, dedup.minhash_signatures(df, 2).collect())) == want


def test_signatures_from_packed_hashes(spark):
    import hashlib

    import numpy as np
    texts = ["a b c d e", "a b c d e", "x y", "", None, "é ü ß 日本 b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    sigs = dedup.minhash_signatures(df, 3)
    assert "conv(" not in sigs._jdf.queryExecution().optimizedPlan().toString()  # hashes leave the JVM as four bytes each
    for r in sigs.collect():
        words = (texts[r.id] or "").split()
        h = [int(hashlib.md5(" ".join(words[i:i + 3]).encode()).hexdigest()[:8], 16) for i in range(len(words) - 2)]
        assert r.sig == [min(((a * x + b) % dedup.PRIME for x in h), default=dedup.EMPTY_SENTINEL) for a, b in dedup.PERMS]
    edge = [0, 1, dedup.PRIME - 1, dedup.PRIME, dedup.PRIME + 1, (1 << 32) - 1, (1 << 32) - 2]
    got = dedup.permutation_minima(np.array(edge, np.uint64), np.ones(len(edge), np.int64))
    assert got.tolist() == [[(a * x + b) % dedup.PRIME for a, b in dedup.PERMS] for x in edge]


@pytest.mark.parametrize("block_rows", [500, 3])
def test_jaccard_of_all_candidate_pairs(spark, monkeypatch, block_rows):
    """Every pair of documents that share a bucket, once, whatever blocks a bucket is cut into: exact and near copies,
    texts without a shingle, ids that repeat, and none for rows without an id."""
    from corpus_spark.operators import candidate_pairs
    monkeypatch.setattr(candidate_pairs, "BLOCK_ROWS", block_rows)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 4 + [" ".join(base[:k] + ["zz"] + base[k + 1:]) for k in range(0, 60, 6)]
    texts += ["one two", "", None, "x"] + [" ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(8)]
    rows = list(enumerate(texts)) + [(2, " ".join(base[:50])), (None, texts[0]), (None, texts[0]), (99, texts[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    buckets = dedup.lsh_buckets(dedup.minhash_signatures(df, 3), 0.8)
    members, sets = {}, {}
    for r in buckets.collect():
        if r.id is not None:
            members.setdefault((r.band, r.bkey), set()).add(r.id)
    for i, t in rows:
        w = (t or "").split()
        sets.setdefault(i, []).append({tuple(w[j:j + 3]) for j in range(len(w) - 2)})
    pairs = {(a, b) for m in members.values() for a in m for b in m if a < b}
    want = sorted((a, b, len(x & y) / len(x | y) if x | y else 1.0) for a, b in pairs for x in sets[a] for y in sets[b])
    got = sorted(map(tuple, dedup.jaccard_verify(df, buckets, 3).collect()))
    assert len(want) > 50 and (0, 1, 1.0) in want and (14, 17, 1.0) in want
    assert got == want


def test_jaccard_verify_query_names_every_pair_of_copies(spark, tmp_path):
    from corpus_spark.queries import QUERIES
    text = "seven small cats sat on mats now"
    spark.createDataFrame([(i, text, "en", "s") for i in range(4)], "doc_id long, text string, lang string, source string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r[0], r[1], r.jaccard) for r in QUERIES["jaccard_verify"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)}
