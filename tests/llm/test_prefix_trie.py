import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import prefix_trie as P
from corpus_spark.llm.prefix_trie import OP13_SQL, end_digests, op13_prefix_trie, prefix_trie, rank_list

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs, base=None, shared=None):
    """``convs``: id -> list of (role, text) in order."""
    made = {c: (convs.get(base(c), [])[:shared(c)] + turns[shared(c):] if base else turns) for c, turns in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    low = lambda who: min(who, key=lambda c: (c is not None, c or 0))
    name = lambda c: "null" if c is None else str(c)
    return sorted(((low(who), len(node), low(members[node[:-1]]) if node else None, len(who), len(kids[node]), leaves[node],
                    saved[node], hashlib.sha256(",".join(map(name, sorted(ends[node], key=lambda c: (c is not None, c or 0))))
                                                .encode()).hexdigest())
                   for node, who in members.items()), key=order)


def order(row):
    return (row[1], row[0] is not None, row[0] or 0, str(row))


def rows(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=order)


def table(spark, convs):
    made = [(c, n, r, t) for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(made)
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("last", [8, 1 << 14])
def test_trie_equals_brute_force(spark, monkeypatch, last):
    monkeypatch.setattr(P, "LAST_ARCS", last)
    monkeypatch.setattr(P.rank_list, "__defaults__", (last,))
    monkeypatch.setattr(P, "CHUNK_IDS", 3)
    rnd = random.Random(last)
    convs = {c: [(rnd.choice("ua"), rnd.choice(["x", "yé", ""])) for _ in range(rnd.choice([1, 2, 3, 5, 9]))]
             for c in rnd.sample(range(-50, 400), 60)}
    assert rows(prefix_trie(table(spark, convs))) == brute(convs)


def test_rebuilt_conversations(spark):
    rnd = random.Random(5)
    convs = {c: [(rnd.choice("ua"), rnd.choice(["x", "y"])) for _ in range(rnd.choice([1, 2, 3, 12]))] for c in range(0, 120)
             if c % 7}
    base, shared = (lambda c: c - c % 5), (lambda c: zlib.crc32(str(c).encode()) % 9)
    got = prefix_trie(table(spark, convs), F.expr("conv - conv % 5"), F.expr("crc32(string(conv)) % 9"))
    assert rows(got) == brute(convs, base, shared)


def test_long_and_hot_conversations_over_many_ranges(spark):
    """A third of all rows in one conversation, and many that are equal; more ranges than that conversation has neighbours."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        convs = {7: [("u", f"t{i % 17}") for i in range(300)], 8: [("u", "t0")] * 40}
        convs |= {100 + i: [("u", "same"), ("a", "answer")] for i in range(150)}
        convs |= {300 + i: [("u", f"t{i % 3}")] for i in range(50)}
        assert rows(prefix_trie(table(spark, convs))) == brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_nulls_ties_repeats_and_clashing_columns(spark):
    made = [(None, 1, "u", "a"), (None, None, None, None), (3, None, "u", "a"), (3, 0, None, ""), (4, 0, "u", None),
            (4, 1, "u", "long " * 20_000), (5, 0, "u", ""), (5, 1, "u", "long " * 20_000), (6, 0, "u", "r"), (6, 0, "u", "r")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in made], SCHEMA + ", conv long, p1 string, depth int")
    convs = {None: [("", ""), ("u", "a")], 3: [("u", "a"), ("", "")], 4: [("u", ""), ("u", "long " * 20_000)],
             5: [("u", ""), ("u", "long " * 20_000)], 6: [("u", "r")] * 2}
    assert rows(prefix_trie(df)) == brute(convs)
    ties = [(1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a")]
    got = rows(prefix_trie(spark.createDataFrame(ties, SCHEMA)))
    assert [r[3] for r in got] == [2, 2, 2]  # the same order in both
    assert rows(prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_rank_list(spark):
    rnd = random.Random(2)
    names = rnd.sample(range(10**6), 500)
    elements = [(names[i], 1, *((names[i + 1], 1) if i < 499 else (None, None)), i, 1) for i in range(500)]
    rnd.shuffle(elements)
    df = spark.createDataFrame(elements, "a long, b long, na long, nb long, w long, one long")
    for last in (10, 1000):
        got = {r.a: (r.w, r.one) for r in rank_list(df, ["w", "one"], last).collect()}
        assert got == {a: (i * (i - 1) // 2, i) for i, a in enumerate(names)}
    ring = spark.createDataFrame([(1, 0, 2, 0, 1), (2, 0, 1, 0, 1)], "a long, b long, na long, nb long, w long")
    with pytest.raises(ValueError):
        rank_list(ring, ["w"])


def test_end_digests_of_a_hot_node(spark, monkeypatch):
    ids = spark.range(20_000).selectExpr("id * 3 AS conv", "0L AS p1", "0L AS p2", "true AS ends")
    (r,) = end_digests(ids).collect()
    assert r.ends_sha256 == hashlib.sha256(",".join(str(3 * i) for i in range(20_000)).encode()).hexdigest()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()
    assert rows(op13_prefix_trie(spark, d)) == sorted(want, key=order)
