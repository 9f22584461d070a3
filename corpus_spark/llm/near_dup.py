"""Near-duplicate documents by fast similarity sketching.

A document's set are its distinct shingles of four words.  Documents with
equal sets form a class and go on as one node, numbered apart from doc_ids,
which rows may repeat or lack.  Each node gets a fast
similarity sketch, bands of the sketch name buckets, and nodes that share a
bucket are candidates; a link is a pair whose full sets are similar enough.

No bucket's pairs are listed.  First every node of a bucket is compared with
the bucket's least node, and the links give components.  Then only buckets
whose nodes are still in more than one component are looked at: their nodes
outside the bucket's largest component are compared, on full sets, with all
others, block by block, and a block gives back no more links than it has
nodes.  So no link between two components of a bucket is lost, and a bucket
that holds very many nodes is many tasks' work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (LOWER, distinct_per_text, documents, hash_spans, join_small, materialize, mix64, shingle_hashes,
                     slices, text_buffer, unused, word_spans)

WORDS = 4
#: A link: 100 * shared shingles >= PERCENT * all shingles of the two sets.
PERCENT = 80
#: 40 bands of 6 coordinates miss a pair of similarity 0.8 once in 190,000.
BANDS = 40
ROWS = 6
#: Nodes and shingles of a block; buckets of more nodes than ``HOT`` are
#: compared with further single nodes before blocks are made.
BLOCK_NODES = 500
BLOCK_SHINGLES = 1 << 20
HOT = 4000
STARS = 6

_NO_ID = -(2**63)

_ROUND_BITS = 9  # up to 2 * 256 rounds


def sketch(hashes: np.ndarray, first: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of each set: ``bins`` coordinates, equal in two
    sets with a probability of their Jaccard similarity.

    In round i < bins every element is thrown into one bin with a value that
    sorts behind all values of earlier rounds, and each bin keeps the least; a
    set is done when all its bins are filled.  What is still empty after as
    many rounds as bins is filled by the rounds that throw all elements into
    one bin each, so every coordinate of a non-empty set is filled.  Rows of
    empty sets hold the largest value."""
    n = len(first) - 1
    out = np.full(n * bins, np.uint64(2**64 - 1))
    sizes = np.diff(first)
    text = np.repeat(np.arange(n), sizes)
    active = sizes > 0
    element, owner = hashes, text
    low = np.uint64((1 << (64 - _ROUND_BITS)) - 1)
    for i in range(bins):
        x = mix64(element + np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64))
        at = owner * bins + ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(i) << np.uint64(64 - _ROUND_BITS)) | (mix64(x) & low)
        np.minimum.at(out, at, value)
        left = active & (out.reshape(n, bins) == np.uint64(2**64 - 1)).any(axis=1)
        if not left.any():
            return out.reshape(n, bins)
        if (left != active).any():
            stay = left[owner]
            element, owner = element[stay], owner[stay]
            active = left
    table = out.reshape(n, bins)
    for t in np.flatnonzero(active).tolist():
        own = hashes[first[t]:first[t + 1]]
        for b in np.flatnonzero(table[t] == np.uint64(2**64 - 1)).tolist():
            x = mix64(mix64(own + np.uint64((0x9E3779B97F4A7C15 * (2 * (bins + b) + 1)) % 2**64)))
            table[t, b] = (np.uint64(bins + b) << np.uint64(64 - _ROUND_BITS)) | (x & low).min()
    return table


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(buf, offsets)
    return distinct_per_text(*shingle_hashes(hash_spans(LOWER[buf], starts, ends), first, words))


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    n, bins = table.shape
    acc = np.zeros((n, bins // rows), np.uint64)
    for j in range(rows):
        acc = mix64(acc + table[:, j::rows][:, :bins // rows] + np.uint64(j + 1))
    return acc


# --- nodes and buckets ------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("content"))


def set_table(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id (null: the smallest long), content
    (hash of the text), n_shingles, set_key (128-bit hash of the set) and bands
    (a key each; none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(*text_buffer(part.column(1)), words)
                n = np.diff(first)
                some = n > 0
                keys = band_keys(sketch(h, np.append(first[:-1][some], first[-1]), bands * rows), rows)
                to = np.concatenate(([0], np.cumsum(some) * bands)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n.astype(np.int64)),
                     pa.array([hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                               for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(to), pa.array(keys.view(np.int64).ravel()))],
                    names=["doc_id", "content", "n_shingles", "set_key", "bands"])
    return _keyed(docs).mapInArrow(run, "doc_id long, content long, n_shingles long, set_key binary, bands array<long>")


def class_table(base: DataFrame) -> DataFrame:
    """One row per distinct non-empty set: set_key, bands, doc_id (the least),
    content (of a row with that doc_id) and node, a number of its own."""
    classes = base.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "content")).alias("least"), F.first("bands").alias("bands"))
    return materialize(classes.select("set_key", "bands", "least.*", F.monotonically_increasing_id().alias("node")),
                       "near-classes")


def bucket_members(classes: DataFrame) -> DataFrame:
    """The nodes of all buckets with more than one node: band, key, node,
    pivot (the least node of the bucket)."""
    rows = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = materialize(rows.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
                         .where("n > 1").drop("n"), "near-buckets")
    return materialize(join_small(rows, shared, ["band", "key"], max_rows=500_000), "near-members")


def node_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The full sets of the nodes that have candidates: node and hashes (the
    sorted shingle hashes, eight bytes each)."""
    wanted = members.select("node").distinct().join(classes.select("node", "set_key", "doc_id", "content"), "node")
    texts = _keyed(docs).join(wanted, ["doc_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(*text_buffer(part.column(1)), words)
                raw = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                # another text with the same hash under the same doc_id is another class
                same = [hashlib.blake2b(r, digest_size=16).digest() == k for r, k in zip(raw, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())],
                                                 names=["node", "hashes"]).filter(pa.array(same))

    found = texts.select("node", "text", "set_key").mapInArrow(run, "node long, hashes binary")
    return materialize(found.dropDuplicates(["node"]), "near-sets")


# --- links --------------------------------------------------------------------------

def _linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets make a link."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b") \
        .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(u), len(v)))
                keep.append(100 * least >= percent * most and _linked(
                    len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, comp: the least node reachable from each node
    that has a link.  Each round takes the least label of all neighbours and
    then the label of that label; rounds are written out."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .distinct(), "near-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("comp")), "near-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        step = materialize(step, "near-step")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        new = materialize(step.join(jump, "comp").select("node", "old", F.col("to").alias("comp")), "near-labels")
        if not new.where("old <> comp").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component, with
    their component."""
    known = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")) \
        .where("lo <> hi and n > 2").select("band", "key", "n")
    return materialize(join_small(known, materialize(mixed, "near-mixed"), ["band", "key"], max_rows=500_000), "near-known")


def _blocks(known: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of block pairs: band, key, i, j, node, comp, side, hashes.  The
    nodes outside a bucket's largest component are dealt into the first
    blocks, the largest component into the others; pairs of two blocks of the
    largest component are left out."""
    sizes = sets.select("node", (F.length("hashes") / 8).cast("long").alias("size"))
    rows = known.join(sizes, "node")
    per = rows.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    buckets = per.groupBy("band", "key").agg(
        F.max(F.struct("n", "comp", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).select(
        "band", "key", F.col("main.comp").alias("main"),
        count(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("n_rest"),
        count(F.col("main.n"), F.col("main.size")).alias("n_main"))
    placed = join_small(rows, materialize(buckets, "near-blocks"), ["band", "key"], max_rows=500_000)
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rest = F.col("comp") != F.col("main")
    own = F.when(rest, deal(F.col("n_rest"))).otherwise(F.col("n_rest") + deal(F.col("n_main")))
    # a block of the rest meets every block, once; a main block meets those of the rest
    others = F.when(rest, F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1)) \
        .otherwise(F.sequence(F.lit(0), F.col("n_rest") - 1))
    spread = placed.withColumn("own", own).withColumn("other", F.explode(others)).select(
        "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp",
        (F.col("own") <= F.col("other")).alias("first"))
    return spread.join(sets, "node")


def block_links(node: np.ndarray, comp: np.ndarray, first: np.ndarray, alone: bool, raw: list[bytes],
                percent: int) -> list[tuple[int, int]]:
    """Links between the components of one pair of blocks: each node of the
    first block is compared with all of the second (``alone``: of the same)
    block; a link that two nodes' components already have is not given again,
    so there are fewer links than nodes."""
    sizes = np.array([len(r) // 8 for r in raw])
    shingles = np.frombuffer(b"".join(raw), np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    order = np.argsort(shingles, kind="stable")
    s, o = shingles[order], owner[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    keep = count[column] > 1  # a shingle of one node alone is shared with nobody
    o, column = o[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    rows, cols = (np.arange(len(raw)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
    shared = np.zeros((len(rows), len(cols)), np.float32)
    spot_r, spot_c = np.full(len(raw), -1), np.full(len(raw), -1)
    spot_r[rows], spot_c[cols] = np.arange(len(rows)), np.arange(len(cols))
    for at in range(0, width, 2048):
        here = (column >= at) & (column < at + 2048)
        n = min(2048, width - at)
        a, b = np.zeros((len(rows), n), np.float32), np.zeros((len(cols), n), np.float32)
        own, c = o[here], column[here] - at
        r = spot_r[own]
        a[r[r >= 0], c[r >= 0]] = 1
        r = spot_c[own]
        b[r[r >= 0], c[r >= 0]] = 1
        shared += a @ b.T
    union = sizes[rows][:, None] + sizes[cols][None, :] - shared
    hit = (100 * shared.astype(np.float64) >= percent * union.astype(np.float64)) & (comp[rows][:, None] != comp[cols][None, :])
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
        a, b = root(int(comp[rows[i]])), root(int(comp[cols[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(node[rows[i]]), int(node[cols[j]])))
    return out


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links of the block pairs of :func:`_blocks`.  A pair of blocks is one
    run of sorted rows of a task, and bounded by the size of a block."""
    key = ("band", "key", "i", "j")
    ordered = rows.select(*key, "node", "comp", "first", "hashes").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def links() -> pa.RecordBatch:
            found = block_links(np.array([r[0] for r in held]), np.array([r[1] for r in held]),
                                np.array([r[2] for r in held]), now[2] == now[3], [r[3] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                               pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != now:
                    if held:
                        yield links()
                    held, now = [], row[:4]
                held.append(row[4:])
        if held:
            yield links()

    return materialize(ordered.mapInArrow(run, "a long, b long"), "near-links")


# --- the operator --------------------------------------------------------------------

def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS, content: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored):
    doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links, its own included), kept (whether that is its own).

    Documents with equal sets are linked.  Null, empty and blank texts have an
    empty set and are linked with nothing; a text of fewer words than a
    shingle has is one shingle.  Null doc_ids are smaller than all others;
    rows that share a doc_id but not a set are linked each by its own set.
    ``content`` adds the hash of the text, which with doc_id names the row.
    """
    base = materialize(set_table(docs, words, bands, rows), "near-base")
    classes = class_table(base)
    members = bucket_members(classes)
    sets = node_sets(docs, classes, members, words)
    links = confirm(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(),
                    sets, percent)
    comps = components(links)
    known = _labelled(members, comps)
    for star in range(STARS):  # very large buckets: compare with other single nodes first
        hot = known.where(F.col("n") > HOT)
        if not hot.limit(1).count():
            break
        pivots = hot.groupBy("band", "key").agg(F.max_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(star))).alias("p"))
        pairs = join_small(hot, materialize(pivots, "near-pivots"), ["band", "key"]).where(F.col("comp") != F.col("p.comp")) \
            .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        more = confirm(pairs, sets, percent)
        if not more.limit(1).count():
            break
        links = links.union(more)
        comps = components(links)
        known = _labelled(members, comps)
    more = compare_blocks(_blocks(known, sets), percent)
    if more.limit(1).count():
        comps = components(links.union(more))
    linked = classes.select("set_key", "node", "doc_id").join(comps, "node", "left") \
        .withColumn("comp", F.coalesce("comp", "node"))
    labelled = materialize(linked, "near-linked")
    # only components of several nodes have another least doc_id than their node
    heads = materialize(labelled.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
                        .where("n > 1").drop("n"), "near-heads")
    labels = join_small(labelled, heads, ["comp"], "left").select("set_key", F.coalesce("least", "doc_id").alias("comp"))
    whole = base.drop("bands").join(labels, "set_key", "left")
    own = F.coalesce("comp", "doc_id")
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return whole.withColumn("component_id", own).withColumn("kept", F.col("doc_id") == own) \
        .select(back("doc_id"), "n_shingles", back("component_id"), "kept", *["content"] * content)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(documents(spark, sf_dir))


def drop_near_duplicates(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``verdicts`` (of
    :func:`near_duplicates` with ``content`` over the same rows) keeps by
    doc_id and text; of rows that repeat both one stays."""
    i, content, n, text = (unused(x, docs) for x in ("_id", "_content", "_n", "_text"))
    keep = materialize(verdicts.where("kept").groupBy(F.col("doc_id").alias(i), F.col("content").alias(content))
                       .agg(F.count("*").alias(n)), "near-kept")
    found = docs.withColumn(text, F.xxhash64("text")).join(
        keep.drop(n), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(text) == F.col(content)), "left_semi")
    if keep.where(F.col(n) > 1).limit(1).count():
        found = found.dropDuplicates(["doc_id", text])
    return found.drop(text)


OP7_SQL = f"""
WITH RECURSIVE k AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS k FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(k[i:i + {WORDS - 1}], ' ')) AS sh
      FROM (SELECT doc_id, k, unnest(range(1, greatest(len(k) - {WORDS - 2}, 2))) AS i FROM k WHERE len(k) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
r(x, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.x)
SELECT x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(comp) AS component_id, x = min(comp) AS kept
FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
