"""The trie of conversation prefixes: what conversations share from their
beginnings on, by the Euler-tour technique.

1. The turns of every conversation are numbered and hashed.  The hash of a
   prefix is a polynomial in the hashes of its turns, so prefix hashes are
   prefix sums: turns are sorted by ranges of (conversation, turn), every task
   sums up what it has, and what a conversation has in earlier ranges is added
   (one row a range reaches the driver).  A conversation of any length is spread
   over many tasks, and texts are read once and never shuffled.
2. Equal prefixes are grouped to nodes.
3. Each node has an enter and an exit arc.  A node's row and its children's
   rows are sorted together by ranges, so each arc's successor is the next row:
   enter goes to the first child's enter, or to the node's own exit; exit goes to
   the next sibling's enter, or to the parent's exit.
4. The tour, one linked list of all arcs, is ranked by random-mate contraction:
   in each round arcs whose coin shows tails take over a successor whose coin
   shows heads, until few arcs are left; those are ranked in one go, and the
   taken ones get their places back in reverse.  A round is one join on unique
   keys; the lists shrink by a quarter each time, so the work of all rounds is
   in proportion to the number of arcs.
5. Arcs carry leaves and savings as weights, so ranking gives their prefix sums
   at every arc; a subtree's totals are the difference between its exit and its
   enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _power_tables, join_small, materialize

#: Stands for a null conversation id (and is the least of all).
NULL_ID = -(2**63)
#: Arcs that are ranked in one go.
LAST_ARCS = 1 << 14
#: Ids of one chunk of a node's list of ends.
CHUNK_IDS = 1 << 13
#: Turns of another conversation that a rebuilt one may begin with.
MOST_SHARED = 8


def _u64(a) -> np.ndarray:
    return np.asarray(a).astype(np.int64, copy=False).view(np.uint64)


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    return np.power(np.uint64(base), exponents.astype(np.uint64))


# --- numbered turns and prefix sums -------------------------------------------------------

_TURNS = "kind int, part int, head boolean, conv long, pos long, k1 long, k2 long, size long, s1 long, s2 long"


def _number_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, k1, k2, size) of one range -> their places and the
    prefix sums before them, counted from where the range begins, and a last
    row (kind 1) on the range: k1 its first conversation, conv its last one,
    pos and s1, s2 the number and the sums of that one's turns here, size 1 if
    the two are the same."""
    part = TaskContext.get().partitionId()
    first = last = None
    count, sums, apart = 0, [np.uint64(0), np.uint64(0)], 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        keys = [_u64(batch.column(i).to_numpy()) for i in (1, 2)]
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = last is None or conv[0] != last
        first = int(conv[0]) if first is None else first
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(new, at, 0))
        goes_on = np.cumsum(new) == 0  # turns of the conversation that the last batch ended with
        inside = at - begin
        up, _ = _power_tables(n)
        with np.errstate(over="ignore"):
            power = up[inside] * np.where(goes_on, np.uint64(pow(_BASE, count, 2**64)), np.uint64(1))
            before = []
            for key, s in zip(keys, sums):
                term = key * power
                total = np.cumsum(term, dtype=np.uint64) - term
                before.append(total - total[begin] + np.where(goes_on, s, np.uint64(0)))
            pos = inside + np.where(goes_on, count, 0)
            head = apart + np.cumsum(new) <= 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(head), batch.column(0),
                 pa.array(pos), batch.column(1), batch.column(2), batch.column(3), _i64(before[0]), _i64(before[1])],
                names=["kind", "part", "head", "conv", "pos", "k1", "k2", "size", "s1", "s2"])
            sums = [b[-1] + k[-1] * power[-1] for b, k in zip(before, keys)]
        apart += int(new.sum())
        last, count = int(conv[-1]), int(pos[-1]) + 1
    if last is not None:
        one = lambda x, t: pa.array([x], t)
        yield pa.RecordBatch.from_arrays(
            [one(1, pa.int32()), one(part, pa.int32()), one(False, pa.bool_()), one(last, pa.int64()), one(count, pa.int64()),
             one(first, pa.int64()), one(0, pa.int64()), one(int(apart == 1), pa.int64()),
             _i64(np.array([sums[0]])), _i64(np.array([sums[1]]))],
            names=["kind", "part", "head", "conv", "pos", "k1", "k2", "size", "s1", "s2"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), k1 and k2 (hashes of role and text), size (UTF-8
    bytes of the text), s1 and s2 (the conversation's prefix sums before this
    turn); one row for each row of ``conversations``.  Turns stand in the order
    of turn (null first), equal ones in the order of the hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv"), F.xxhash64(role, text).alias("k1"),
        F.xxhash64(text, F.lit("2"), role).alias("k2"), F.octet_length(text).cast("long").alias("size"), "turn",
        F.monotonically_increasing_id().alias("nth"))  # rows that are the same in all columns may be many
    order = ("conv", "turn", "k1", "k2", "nth")
    raw = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "k1", "k2", "size")
                      .mapInArrow(_number_turns, _TURNS), "turn-ranges")
    ahead: dict[int, tuple[int, int, int]] = {}
    carry = None  # (conversation, turns, sums) of the last conversation so far
    for r in sorted(raw.where("kind = 1").collect(), key=lambda r: r["part"]):  # one row for each range
        goes_on = carry is not None and carry[0] == r["k1"]
        if goes_on:
            ahead[r["part"]] = carry[1:]
        here = (r["conv"], r["pos"], r["s1"] % 2**64, r["s2"] % 2**64)
        if goes_on and r["size"] == 1:
            shift = pow(_BASE, carry[1], 2**64)
            here = (here[0], carry[1] + here[1], (carry[2] + shift * here[2]) % 2**64, (carry[3] + shift * here[3]) % 2**64)
        carry = here

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, head = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            pos = batch.column(3).to_numpy().copy()
            s = [_u64(batch.column(i).to_numpy()).copy() for i in (7, 8)]
            with np.errstate(over="ignore"):
                for p in np.unique(part[head]).tolist():
                    if p in ahead:
                        at = head & (part == p)
                        count, *sums = ahead[p]
                        pos[at] += count
                        for x, add in zip(s, sums):
                            x[at] = x[at] * np.uint64(pow(_BASE, count, 2**64)) + np.uint64(add)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(pos), *(batch.column(i) for i in (4, 5, 6)), _i64(s[0]), _i64(s[1])],
                names=["conv", "pos", "k1", "k2", "size", "s1", "s2"])

    rows = raw.where("kind = 0").select("part", "head", "conv", "pos", "k1", "k2", "size", "s1", "s2")
    return materialize(rows.mapInArrow(shift, "conv long, pos long, k1 long, k2 long, size long, s1 long, s2 long"), "turns")


# --- members of nodes ---------------------------------------------------------------------

_MEMBERS = "conv long, depth long, p1 long, p2 long, q1 long, q2 long, size long, ends boolean"


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the prefixes that end with a turn (p1, p2) and of those before
    it (q1, q2), from prefix sums of the conversation the turn is from (s),
    those before the first turn taken from it (o), and those of the prefix in
    front of it (b); ``shared`` turns stand in front, ``skipped`` are not taken."""
    for batch in batches:
        col = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
        depth = col["shared"] + col["pos"] - col["skipped"] + 1
        out = {}
        with np.errstate(over="ignore"):
            back = _power(_BASE_INV, col["skipped"] - col["shared"])
            power = _power(_BASE, depth - 1)
            # sums of the turns in front, from the last of them
            front = _power(_BASE, np.maximum(col["shared"] - 1, 0))
            for i in "12":
                b = np.where(col["shared"] > 0, _u64(col["b" + i]) + _u64(col["bk" + i]) * front, np.uint64(0))
                out["q" + i] = b + back * (_u64(col["s" + i]) - _u64(col["o" + i]))
                out["p" + i] = out["q" + i] + _u64(col["k" + i]) * power
        even = ~np.uint64(1)  # the lowest bit tells a node's two arcs apart
        yield pa.RecordBatch.from_arrays(
            [pa.array(col["conv"]), pa.array(depth), _i64(out["p1"] & even), _i64(out["p2"]), _i64(out["q1"] & even),
             _i64(out["q2"]), pa.array(col["size"]), pa.array(depth == col["length"])],
            names=["conv", "depth", "p1", "p2", "q1", "q2", "size", "ends"])


def trie_members(conversations: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """One row for each prefix, the empty one included, of each conversation:
    conv, depth, its key p1, p2, its parent's key q1, q2, the bytes of its last
    text and whether the conversation ends there.

    With ``base`` and ``shared`` (columns of ``conv``) each conversation is
    rebuilt first: it begins with the first ``shared`` (at most 8) turns of the
    conversation ``base``, all if that has fewer, none if there is no such
    conversation; its own turns follow after its first ``shared``."""
    turns = numbered_turns(conversations)
    base = F.col("conv") if base is None else base
    shared = F.lit(0) if shared is None else shared
    entry = F.when(F.col("pos") <= MOST_SHARED, F.struct("pos", "k1", "k2", "size", "s1", "s2"))
    every = materialize(turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("first")),
                        "conversations")
    plan = every.select("conv", "n", "first", base.alias("base"), shared.cast("long").alias("skipped"))
    heads = every.select(F.col("conv").alias("base"), F.col("first").alias("front"))
    plan = plan.join(heads, "base", "left").withColumn(
        "shared", F.when(F.col("front").isNull(), 0).otherwise(F.least("skipped", F.size("front"))).cast("long"))
    plan = plan.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0)))
    own = F.get("first", F.col("skipped").cast("int"))
    before = F.get("front", F.col("shared").cast("int") - 1)
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    plan = materialize(plan.select(
        "conv", "skipped", "shared", "length", F.slice("front", 1, F.col("shared").cast("int")).alias("front"),
        *(some(own["s" + i]).alias("o" + i) for i in "12"),
        *(some(before[a + i]).alias(b + i) for a, b in (("s", "b"), ("k", "bk")) for i in "12")), "rebuilt-conversations")
    columns = ["conv", "skipped", "shared", "length", "pos", "k1", "k2", "size", "s1", "s2", "o1", "o2", "b1", "b2", "bk1", "bk2"]
    zero = {c: F.lit(0).cast("long") for c in ("skipped", "shared", "o1", "o2", "b1", "b2", "bk1", "bk2")}
    front = plan.select("conv", "length", F.explode("front").alias("f")).select("conv", "length", "f.*") \
        .withColumns(zero).select(columns)
    rest = join_small(turns, plan.drop("front"), ["conv"]).where("pos >= skipped").select(columns)
    nothing = F.lit(None).cast("long")
    root = plan.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")), nothing.alias("q1"),
                       nothing.alias("q2"), F.lit(0).cast("long").alias("size"), (F.col("length") == 0).alias("ends"))
    return materialize(front.unionByName(rest).mapInArrow(_prefix_keys, _MEMBERS).unionByName(root), "trie-members")


# --- who ends where -----------------------------------------------------------------------

def _id_text(ids: np.ndarray) -> str:
    return ",".join("null" if i == NULL_ID else str(i) for i in ids.tolist())


def _end_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, conv) of one range -> the digest of each node's ids, or,
    of the range's first and last node, which may go on in other ranges, the ids
    in numbered chunks."""
    part, nth = TaskContext.get().partitionId(), 0
    closed: list[tuple] = []
    node, first, ids = None, True, []

    def row(digest: str | None, text: str | None) -> tuple:
        nonlocal nth
        nth += 1
        return (*node, part, nth, digest, text)

    def close(last: bool) -> None:
        nonlocal first, ids
        text = _id_text(np.concatenate(ids))
        closed.append(row(None, text) if first or last else row(hashlib.sha256(text.encode()).hexdigest(), None))
        first, ids = False, []

    def emit() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in closed], t) for i, t in enumerate(types)],
                                         names=["p1", "p2", "part", "nth", "digest", "ids"])
        closed.clear()
        return out

    for batch in batches:
        p1, p2, conv = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(p1), bool)
        new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        begin = np.flatnonzero(new)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(p1)).tolist()):
            key = (int(p1[a]), int(p2[a]))
            if node is not None and key != node:
                close(False)
            node = key
            for i in range(a, b, CHUNK_IDS):
                # a list that is this long already is passed on in chunks, whatever node it is of
                if sum(map(len, ids)) + min(b - i, CHUNK_IDS) > CHUNK_IDS:
                    closed.append(row(None, _id_text(np.concatenate(ids))))
                    ids, first = [], True
                ids.append(conv[i:min(i + CHUNK_IDS, b)])
        yield emit()
    if node is not None:
        close(True)
        yield emit()


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> one digest for each node; a chunk is held at a time."""
    node = sha = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()),
                                           pa.array([sha.hexdigest()], pa.string())], names=["p1", "p2", "ends_sha256"])

    for batch in batches:
        for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if (a, b) != node:
                if node is not None:
                    yield done()
                node, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
    if node is not None:
        yield done()


def end_digests(members: DataFrame) -> DataFrame:
    """p1, p2 and ends_sha256, the SHA-256 of the ids of the conversations that
    end there, ascending, joined by commas (null: ``null``, first); nodes at
    which none ends have no row.

    Ids are sorted by ranges, so those of a node at which a third of all
    conversations end are put in order and spelled out by many tasks; a digest
    is one pass by its definition, so their chunks of text then go through one
    task, one at a time."""
    order = ("p1", "p2", "conv")
    ends = members.where("ends").select(*order)
    chunks = materialize(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _end_chunks, "p1 long, p2 long, part int, nth long, digest string, ids string"), "trie-ends")
    open_ = chunks.where("digest IS NULL").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part", "nth") \
        .select("p1", "p2", "ids").mapInArrow(_digest_chunks, "p1 long, p2 long, ends_sha256 string")
    return chunks.where("digest IS NOT NULL").select("p1", "p2", F.col("digest").alias("ends_sha256")).unionByName(open_)


# --- the Euler tour -----------------------------------------------------------------------

_ARCS = ("kind int, part int, open boolean, orphan boolean, a long, b long, na long, nb long, leaves long, saved long, "
         "parent long")


def _link_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range (g1, g2, flag, c1, c2, conv, leaves, saved: a
    node's row, flag 0, before its children's rows) -> the enter arc of each
    node's row and the exit arc of each child's row, with its successor.
    ``open``: the last row, whose successor a child in the next range may be;
    ``orphan``: a child whose parent's row is in an earlier range.  The last row
    (kind 1) tells whether the range's first row is a child (leaves) and which
    (na, nb), and the conversation of its last node's row (parent)."""
    part = TaskContext.get().partitionId()
    held = first = parent = None
    names = ["g1", "g2", "flag", "c1", "c2", "conv", "leaves", "saved"]

    def arcs(row: dict[str, np.ndarray], more: bool) -> pa.RecordBatch:
        """Arcs of all rows, or, with ``more``, of all but the last."""
        nonlocal parent
        n = len(row["g1"]) - more
        child = row["flag"][:n] == 1
        nxt = np.zeros(n, bool)
        same = (row["g1"][1:] == row["g1"][:-1]) & (row["g2"][1:] == row["g2"][:-1])
        nxt[:len(same)] = same[:n]
        follow = lambda c, end: np.where(nxt, np.append(row[c][1:], 0)[:n], end)
        g1, g2 = row["g1"][:n], row["g2"][:n]
        at = np.maximum.accumulate(np.where(child, -1, np.arange(n)))
        over = np.where(at >= 0, row["conv"][np.maximum(at, 0)], NULL_ID if parent is None else parent)
        orphan = child & (at < 0) & (parent is None)
        own = pa.array(over, mask=~child | orphan)
        if n and at[-1] >= 0:
            parent = int(row["conv"][at[-1]])
        open_ = np.zeros(n, bool)
        if n and not more:
            open_[-1] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(open_), pa.array(orphan),
             pa.array(np.where(child, row["c1"][:n] | 1, g1)), pa.array(np.where(child, row["c2"][:n], g2)),
             pa.array(follow("c1", g1 | 1)), pa.array(follow("c2", g2)),
             pa.array(np.where(child, 0, row["leaves"][:n])), pa.array(np.where(child, 0, row["saved"][:n])), own],
            names=["kind", "part", "open", "orphan", "a", "b", "na", "nb", "leaves", "saved", "parent"])

    for batch in batches:
        if not batch.num_rows:
            continue
        row = {n: batch.column(i).to_numpy() for i, n in enumerate(names)}
        if first is None:
            first = [int(row[c][0]) for c in ("flag", "c1", "c2")]
        if held is not None:
            row = {n: np.append(held[n], row[n]) for n in names}
        held = {n: row[n][-1:] for n in names}
        yield arcs(row, True)
    if held is not None:
        yield arcs(held, False)
        one = lambda x, t=pa.int64(): pa.array([x], t)
        yield pa.RecordBatch.from_arrays(
            [one(1, pa.int32()), one(part, pa.int32()), one(False, pa.bool_()), one(False, pa.bool_()), one(0), one(0),
             one(first[1]), one(first[2]), one(first[0]), one(0), one(parent)],
            names=["kind", "part", "open", "orphan", "a", "b", "na", "nb", "leaves", "saved", "parent"])


def euler_tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (p1, p2, q1, q2: null for the root, conv, n_convs, size,
    n_children) -> ``(arcs, parents)``: a, b (a node's key; the lowest bit of a
    is set in exit arcs), the successor's na, nb (null for the root's exit),
    leaves and saved of the nodes that the arc enters; and for each node but the
    root the conversation of its parent."""
    spark = nodes.sparkSession
    weights = ((F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    rows = nodes.select(F.col("p1").alias("g1"), F.col("p2").alias("g2"), F.lit(0).alias("flag"), F.col("p1").alias("c1"),
                        F.col("p2").alias("c2"), "conv", *weights).unionByName(
        nodes.where("q1 IS NOT NULL").select(F.col("q1").alias("g1"), F.col("q2").alias("g2"), F.lit(1).alias("flag"),
                                             F.col("p1").alias("c1"), F.col("p2").alias("c2"), "conv", *weights))
    order = ("g1", "g2", "flag", "c1", "c2")
    linked = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_link_arcs, _ARCS), "arc-ranges")
    ranges = sorted(linked.where("kind = 1").collect(), key=lambda r: r["part"])  # one row for each range
    above, known = None, []
    for r, after in zip(ranges, [*ranges[1:], None]):
        child = after is not None and after["leaves"] == 1
        known.append((r["part"], above, *((after["na"], after["nb"]) if child else (None, None))))
        above = r["parent"] if r["parent"] is not None else above
    borders = F.broadcast(spark.createDataFrame(known, "part int, above long, fa long, fb long"))  # one row for each range
    fixed = linked.where("kind = 0").join(borders, "part", "left")
    on = F.col("open") & F.col("fa").isNotNull()
    arcs = fixed.select("a", "b", F.when(on, F.col("fa")).otherwise(F.col("na")).alias("na"),
                        F.when(on, F.col("fb")).otherwise(F.col("nb")).alias("nb"), "leaves", "saved")
    # the root's exit ends the tour; it is no child's arc
    end = spark.createDataFrame([(1, 0, None, None, 0, 0)] if ranges else [], arcs.schema)
    parents = fixed.where(F.col("a").bitwiseAND(F.lit(1)) == 1).select(
        F.col("a").bitwiseAND(F.lit(-2)).alias("p1"), F.col("b").alias("p2"),
        F.when(F.col("orphan"), F.col("above")).otherwise(F.col("parent")).alias("parent"))
    return arcs.unionByName(end), parents


def rank_list(elements: DataFrame, weights: list[str], last: int = LAST_ARCS) -> DataFrame:
    """``elements`` of one linked list (key a, b; key na, nb of the next one,
    null for the last; long ``weights``) -> a, b, and for each weight the sum
    over the elements before.

    Random-mate contraction: an element whose coin shows tails takes over its
    successor if that one's shows heads.  Each round is one join on unique keys
    and leaves three quarters of the list; ``last`` elements at most are ranked
    on the driver."""
    spark = elements.sparkSession
    plain = ["a", "b", "na", "nb", *weights]
    rounds: list[DataFrame] = []
    left = materialize(elements.select(plain), "list")
    while left.count() > last:
        coin = F.pmod(F.xxhash64("a", "b", F.lit(len(rounds))), F.lit(2))
        t = left.where(coin == 0).select(*(F.col(c).alias("t_" + c) for c in plain))
        h = left.where(coin == 1).select(*(F.col(c).alias("h_" + c) for c in plain))
        both = t.join(h, (t["t_na"] == h["h_a"]) & (t["t_nb"] == h["h_b"]), "full_outer")
        taken = F.col("t_a").isNotNull() & F.col("h_a").isNotNull()
        stay = lambda c: F.coalesce("t_" + c, "h_" + c)
        goes = lambda c: F.when(F.col("h_a").isNotNull(), F.col("h_" + c)).otherwise(F.col("t_" + c))
        rounds.append(materialize(both.select(
            stay("a").alias("a"), stay("b").alias("b"), goes("na").alias("na"), goes("nb").alias("nb"),
            *((F.coalesce("t_" + w, F.lit(0)) + F.coalesce("h_" + w, F.lit(0))).alias(w) for w in weights),
            F.when(taken, F.col("h_a")).alias("ra"), F.when(taken, F.col("h_b")).alias("rb"),
            *(F.when(taken, F.col("t_" + w)).alias("r_" + w) for w in weights)), "list"))
        left = rounds[-1].select(plain)
    rest = {(r["a"], r["b"]): r for r in left.collect()}
    targets = {(r["na"], r["nb"]) for r in rest.values()}
    at = next((k for k in rest if k not in targets), None)
    ranked, sums = [], [0] * len(weights)
    while at in rest:
        r = rest[at]
        ranked.append((*at, *sums))
        sums = [s + r[w] for s, w in zip(sums, weights)]
        at = (r["na"], r["nb"])
    if len(ranked) != len(rest):
        raise ValueError("the elements are not one list")
    known = spark.createDataFrame(ranked, "a long, b long, " + ", ".join(f"{w} long" for w in weights))
    for i, made in reversed(list(enumerate(rounds))):
        before = made.select("a", "b", "ra", "rb", *("r_" + w for w in weights))
        here = F.struct("a", "b", *weights)
        there = F.struct(F.col("ra").alias("a"), F.col("rb").alias("b"), *((F.col(w) + F.col("r_" + w)).alias(w) for w in weights))
        rows = before.join(known, ["a", "b"]).select(F.explode(F.when(
            F.col("ra").isNotNull(), F.array(here, there)).otherwise(F.array(here))).alias("e")).select("e.*")
        known = materialize(rows, "ranks") if i % 3 == 0 else rows
    return known


# --- the trie -----------------------------------------------------------------------------

def prefix_trie(conversations: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """The trie of the prefixes of all conversations (conv_id, turn, role,
    text; more columns are ignored), one row for each node: conv_id (smallest
    member), depth, parent_conv_id (the parent's conv_id; root: null), n_convs
    (members), n_children, n_leaves (nodes without children in its subtree),
    saved_tokens (over its subtree, the sum of (n_convs - 1) times the UTF-8
    bytes of a node's last text), ends_sha256 (of the ids of the conversations
    that are just this prefix, see :func:`end_digests`).

    Null roles and texts are empty.  Null turns come first; turns with the same
    number stand in the order of their hashes, repeated rows are turns of their
    own.  Rows with a null conv_id are one conversation, whose id is the least
    of all and comes out as null.  An empty table has no nodes.  Prefixes are
    told apart by 127 bits of hash.  ``base`` and ``shared``: see
    :func:`trie_members`."""
    members = trie_members(conversations, base, shared)
    nodes = members.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.first("size").alias("size"),
        F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")) \
        .agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["p1", "p2"], "left").fillna(0, ["n_children"]), "trie-nodes")
    arcs, parents = euler_tour(nodes)
    ranks = rank_list(arcs, ["leaves", "saved"])
    leave = F.col("a").bitwiseAND(F.lit(1)) == 1
    total = lambda w: F.sum(F.when(leave, F.col(w)).otherwise(-F.col(w)))
    subtrees = ranks.groupBy(F.col("a").bitwiseAND(F.lit(-2)).alias("p1"), F.col("b").alias("p2")).agg(
        total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"))
    key = ["p1", "p2"]
    found = nodes.join(subtrees, key).join(parents, key, "left").join(end_digests(members), key, "left")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("conv").alias("conv_id"), "depth", real("parent").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each of which begins with up to eight
    turns of the one whose id is the next lower multiple of five."""
    known = F.col("conv") != NULL_ID
    base = F.when(known, F.col("conv") - F.col("conv") % 5).otherwise(F.col("conv"))
    shared = F.when(known, F.crc32(F.col("conv").cast("string")) % 9).otherwise(0)
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), base, shared)


_CRC32 = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda r, x: list_reduce(list_concat([xor(r, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations),
i AS (SELECT c, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, 0 AS own, t.pos, role, text FROM i JOIN t ON t.c = i.c - i.c % 5 WHERE t.pos < i.h
      UNION ALL SELECT i.c, 1, t.pos, role, text FROM i JOIN t ON t.c = i.c WHERE t.pos >= i.h),
q AS (SELECT c, row_number() OVER w AS depth, strlen(text) AS size,
             string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w AS path
      FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
p AS (SELECT c, depth, size, sha256(path) AS node FROM q UNION ALL SELECT c, 0, 0, 'root' FROM i),
n AS (SELECT node, depth, min(c) AS c, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY node, depth),
up AS (SELECT n.node, n.depth, p.node AS above, p.depth AS high, (n_convs - 1) * n.size AS saved
       FROM n JOIN p ON p.c = n.c AND p.depth <= n.depth),
kids AS (SELECT above AS node, count(*) AS k FROM up WHERE high = depth - 1 GROUP BY above),
sums AS (SELECT above AS node, sum(saved) AS saved, count(*) FILTER (k IS NULL) AS leaves
         FROM up LEFT JOIN kids ON kids.node = up.node GROUP BY above),
e AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
      FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY node)
SELECT n.c::BIGINT AS conv_id, n.depth::BIGINT AS depth, a.c::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN e USING (node)
LEFT JOIN up ON up.node = n.node AND up.high = n.depth - 1 LEFT JOIN n AS a ON a.node = up.above
"""
