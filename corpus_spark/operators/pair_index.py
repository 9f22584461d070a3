"""Byte-pair merges from an inverted index of symbol pairs.

:class:`PairIndex` is one table, in Parquet, sorted by pair: ``(key, w, count)``
with one row for each pair and each distinct word that holds it (``w``: the
word's symbol numbers when the index was written).  The pair counts of all
words are taken once; after that a round reads only the rows of the pairs it
merges (a filter on the sorted key, pushed down to the scan), replays on them
the merges made since the index was written, and returns the changes of counts.
Nothing else of the words is touched.

The first merges are of pairs that a large part of the words holds.  As long as
that is so, :class:`WordScan` reads the words themselves in every round: the
index would have a row for each pair of a word, and most would be read.

:class:`MergeLoop` holds the ``TOP_PAIRS`` most frequent pairs on the driver
and the boundary behind them: no other pair can come before it, since counts of
pairs of old symbols only fall, and every pair of a new symbol is reported
complete by the round that makes the symbol.  A round guesses the next merges
(by making them on the most frequent words, which it holds for this alone) and
asks for the changes merge by merge; merges are accepted as long as the
guess is what training one by one would choose, so the result is the same.
"""

from __future__ import annotations

import heapq
from copy import copy
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Pairs held on the driver between two readings of all words.
TOP_PAIRS = 20_000
#: Merges after which the index is written anew.
EPOCH = 512
#: Most merges guessed in one round.
GUESSES = 48
#: Words that the driver holds to guess by.
GUESS_WORDS = 50_000
#: Words of more symbols are one row of the index (key -1), not one for each pair.
LONG_WORD = 64
#: An index is written once the pairs of a round have less than one in so many places.
INDEX_SHARE = 64
#: Merges after which words that are read without an index are written anew.
SCAN_EPOCH = 256
#: Symbols of words that hold wanted pairs, worked off at a time.
CHUNK_SYMBOLS = 1 << 20
#: Wanted pairs up to which the scan's filter names each of them.
NAMED_KEYS = 200

Merge = tuple[int, int, int]


def merge_pairs(flat: np.ndarray, offsets: np.ndarray, merges: Sequence[Merge]) -> tuple[np.ndarray, np.ndarray]:
    """Apply merges (a, b, new), one after the other, to the symbols of all
    words at once (``offsets``: where each word begins); of overlapping places
    (``a`` equal to ``b``) the left one wins."""
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a, b, new in merges:
        hit = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & (word[:-1] == word[1:]))
        if not len(hit):
            continue
        if a == b:
            start = np.ones(len(hit), bool)
            start[1:] = np.diff(hit) > 1
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
        flat = flat.copy()
        flat[hit] = new
        keep = np.ones(len(flat), bool)
        keep[hit + 1] = False
        flat, word = flat[keep], word[keep]
    return flat, np.searchsorted(word, np.arange(len(offsets)))


def _symbols(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy()[off[0]:off[-1]], off - off[0]


def _lists(flat: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _pairs(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all adjacent symbols, and the word each stands in."""
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = word[:-1] == word[1:]
    return flat[:-1][inside].astype(np.int64) << 32 | flat[1:][inside], word[:-1][inside]


def _some_words(flat: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the words marked in ``chosen``."""
    size = np.diff(off)
    return flat[np.repeat(chosen, size)], np.concatenate([[0], np.cumsum(size[chosen])])


def replay(flat: np.ndarray, off: np.ndarray, merges: Sequence[Merge]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`merge_pairs` of many merges: in each pass every word makes its
    next merge (the first in it after its last one), so there are as many
    passes as merges in a word, not as there are merges."""
    if not len(merges):
        return flat, off
    made = np.array(merges, np.int64)
    size = len(made) + 1
    keys, number = np.unique(made[:, 0] << 32 | made[:, 1], return_inverse=True)
    # a pair may have been merged more than once: its turns in order
    turns = np.sort(number * size + np.arange(len(made)))
    names, done = np.arange(len(off) - 1), []
    last = np.full(len(names), -1)
    while len(names):
        word = np.repeat(np.arange(len(off) - 1), np.diff(off))
        at = np.flatnonzero(word[:-1] == word[1:])
        key = flat[at].astype(np.int64) << 32 | flat[at + 1]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        some = keys[k] == key
        at, k, w = at[some], k[some], word[at[some]]
        j = np.minimum(np.searchsorted(turns, k * size + last[w] + 1), len(turns) - 1)
        some = (turns[j] // size == k) & (turns[j] % size > last[w])
        at, w, turn = at[some], w[some], turns[j[some]] % size
        turn_of = np.full(len(names), size)
        np.minimum.at(turn_of, w, turn)
        going = turn_of < size
        at = at[turn == turn_of[w]]
        # of overlapping places the left one wins
        start = np.ones(len(at), bool)
        start[1:] = np.diff(at) > 1
        nth = np.arange(len(at))
        at = at[(nth - np.maximum.accumulate(np.where(start, nth, 0))) % 2 == 0]
        flat = flat.copy()
        flat[at] = made[turn_of[word[at]], 2]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        off = np.concatenate([[0], np.cumsum(np.bincount(word[keep], minlength=len(names)))])
        flat = flat[keep]
        done.append((names[~going], *_some_words(flat, off, ~going)))
        flat, off = _some_words(flat, off, going)
        names, last = names[going], turn_of[going]
    # the words in their order again
    order = np.concatenate([n for n, _, _ in done]) if done else names
    sizes = np.concatenate([np.diff(o) for _, _, o in done]) if done else names
    parts = np.concatenate([f for _, f, _ in done]) if done else flat
    back = np.argsort(np.repeat(order, sizes), kind="stable")
    return parts[back], np.concatenate([[0], np.cumsum(sizes[np.argsort(order)])]).astype(np.int64)


def key_of(a: int, b: int) -> int:
    return a << 32 | b


class LinkedWords:
    """Symbols of words that occur ``count`` times, as linked lists, and the
    places of the symbols that ``merges`` begin with.  A merge looks at the
    places of its left symbol only."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, count: np.ndarray, merges: Sequence[Merge]):
        size = np.diff(off)
        self.symbol = flat.astype(np.int64)
        self.after, self.before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        self.after[off[1:][size > 0] - 1] = -1
        self.before[off[:-1][size > 0]] = -1
        self.weight = np.repeat(count, size)
        begins = np.unique(np.array([a for a, _, _ in merges], np.int64))
        wanted = np.zeros(max(self.symbol.max(initial=0), begins.max(initial=0)) + 1, bool)
        wanted[begins] = True
        at = np.flatnonzero(wanted[self.symbol])
        at = at[np.argsort(self.symbol[at], kind="stable")]
        bounds = np.searchsorted(self.symbol[at], np.append(begins, len(wanted)))
        self.places = {a: at[x:y] for a, x, y in zip(begins.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())}
        self.marked = np.zeros(len(flat), bool)

    def copy(self) -> "LinkedWords":
        out = copy(self)
        out.symbol, out.after, out.before, out.places = self.symbol.copy(), self.after.copy(), self.before.copy(), dict(self.places)
        return out

    def _pairs(self, ahead: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at ``places``, and at those ``ahead`` that are not among them."""
        for p in places:
            self.marked[p] = True
        at = np.concatenate([ahead[(ahead >= 0) & ~self.marked[ahead]], *places])
        for p in places:
            self.marked[p] = False
        return self.symbol[at] << 32 | self.symbol[self.after[at]], self.weight[at]

    def merge(self, a: int, b: int, new: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Make a merge, of overlapping places the left one; what it takes from
        and adds to the counts of pairs: ``(keys, changes)``."""
        at = self.places.get(a, np.zeros(0, np.int64))
        at = self.places[a] = at[self.symbol[at] == a]
        to = self.after[at]
        hit = (to >= 0) & (self.symbol[to] == b)
        at, to = at[hit], to[hit]
        if not len(at):
            return None
        if a == b:
            start = np.ones(len(at), bool)
            start[1:] = to[:-1] != at[1:]
            nth = np.arange(len(at))
            left = (nth - np.maximum.accumulate(np.where(start, nth, 0))) % 2 == 0
            at, to = at[left], to[left]
        behind = self.after[to]
        inner = behind >= 0
        if counted:
            lost, less = self._pairs(self.before[at], at, to[inner])
        self.symbol[at], self.symbol[to] = new, -1
        self.after[at] = behind
        self.before[behind[inner]] = at[inner]
        known = self.places.get(new, ())
        self.places[new] = np.union1d(known, at) if len(known) else at
        if not counted:
            return None
        won, more = self._pairs(self.before[at], at[inner])
        return np.concatenate([lost, won]), np.concatenate([-less, more])


def _chunks(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Words ``(flat, offsets, count)`` of several batches put together."""
    held: list = []
    for part in parts:
        if len(part[0]):
            held.append(part)
        if sum(len(f) for f, _, _ in held) >= CHUNK_SYMBOLS:
            yield _together(held)
            held = []
    if held:
        yield _together(held)


def _together(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(off) for _, off, _ in parts])
    return (np.concatenate([f for f, _, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]),
            np.concatenate([c for _, _, c in parts]))


class PairIndex:
    """The inverted index of a table ``words`` (w: symbol numbers, count)."""

    def __init__(self, words: DataFrame):
        def rows(batches):
            for batch in batches:
                flat, off = _symbols(batch.column(0))
                key, word = _pairs(flat, off)
                key = np.where(np.diff(off)[word] > LONG_WORD, -1, key)
                one = pd.DataFrame({"key": key, "word": word}).drop_duplicates()
                at = pa.array(one["word"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(one["key"].to_numpy()), batch.column(0).take(at),
                                                  batch.column(1).take(at)], names=["key", "w", "count"])

        # a hot pair is spread by the hash of its words
        self.table = written(words.mapInArrow(rows, "key long, w array<int>, count long")
                             .repartitionByRange(F.col("key"), F.xxhash64("w")).sortWithinPartitions("key"), "pair-index")

    def _rows(self, keys: Iterable[int]) -> tuple[DataFrame, np.ndarray]:
        wanted = np.unique(np.fromiter(keys, np.int64))
        if len(wanted) <= NAMED_KEYS:
            test = F.col("key") == -1
            for k in wanted.tolist():
                test = test | (F.col("key") == k)
        else:
            test = F.col("key").isin(-1, *wanted.tolist())
        return self.table.filter(test), wanted

    @staticmethod
    def _held(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every word that holds a wanted pair, once: in the row of the first
        wanted pair in it (or in its only row)."""
        flat, off = _symbols(batch.column(1))
        key, word = _pairs(flat, off)
        hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
        first, at = np.unique(word[hit], return_index=True)
        row = batch.column(0).to_numpy()[first]
        chosen = np.zeros(len(off) - 1, bool)
        chosen[first[(row == -1) | (row == key[hit][at])]] = True
        return *_some_words(flat, off, chosen), batch.column(2).to_numpy()[chosen]

    def changes(self, keys: Iterable[int], before: Sequence[Merge], steps: Sequence[Merge], least: int,
                whole: Sequence[int]) -> list:
        """``(step, key, d)``: how each of ``steps``, made one after the other
        after the merges ``before``, changes the pair counts.  ``keys`` are
        the pairs of the index that any place of a step begins or ends in.
        Rises to less than ``least`` are left out but for the steps in
        ``whole``."""
        table, wanted = self._rows(keys)
        before, steps = tuple(before), tuple(steps)

        def run(batches):
            for flat, off, count in _chunks(PairIndex._held(batch, wanted) for batch in batches):
                words = LinkedWords(flat, off, count, before + steps)
                for step in before:
                    words.merge(*step, counted=False)
                found = []
                for i, step in enumerate(steps):
                    made = words.merge(*step)
                    if made:
                        found.append(pd.DataFrame({"key": made[0], "d": made[1]}).groupby("key", as_index=False)["d"].sum()
                                     .assign(step=i))
                if found:
                    d = pd.concat(found)[["step", "key", "d"]]
                    yield pa.RecordBatch.from_pandas(d[d["d"] != 0].astype("int64"), preserve_index=False)

        # numbers only: at most six pairs for each symbol and step
        return (table.mapInArrow(run, "step long, key long, d long").groupBy("step", "key").agg(F.sum("d").alias("d"))
                .filter((F.col("d") < 0) | (F.col("d") >= least) | F.col("step").isin([-1, *whole])).collect())

    def totals(self, keys: Iterable[int], before: Sequence[Merge], pairs: Sequence[int]) -> dict[int, int]:
        """The counts of ``pairs`` after the merges ``before``."""
        table, wanted = self._rows(keys)
        before, asked = tuple(before), np.unique(np.array(pairs, np.int64))

        def run(batches):
            for batch in batches:
                flat, off, count = PairIndex._held(batch, wanted)
                key, word = _pairs(*replay(flat, off, before))
                hit = np.isin(key, asked)
                d = pd.DataFrame({"key": key[hit], "n": count[word[hit]]}).groupby("key", as_index=False)["n"].sum()
                yield pa.RecordBatch.from_pandas(d.astype("int64"), preserve_index=False)

        return {r["key"]: r["n"] for r in
                table.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


class WordScan(PairIndex):
    """The same from the table ``words`` itself, all of which every round reads."""

    def __init__(self, words: DataFrame):
        self.table = words.select(F.lit(-1).cast("long").alias("key"), "w", "count")

    def _rows(self, keys: Iterable[int]) -> tuple[DataFrame, np.ndarray]:
        return self.table, np.unique(np.fromiter(keys, np.int64))


def _merged(words: DataFrame, merges: Sequence[Merge]) -> DataFrame:
    """``words`` after the merges, without words of one symbol, which no merge
    touches any more."""
    merges = tuple(merges)

    def run(batches):
        for batch in batches:
            flat, off = replay(*_symbols(batch.column(0)), merges)
            out = pa.RecordBatch.from_arrays([_lists(flat, off), batch.column(1)], names=["w", "count"])
            yield out.filter(pa.array(np.diff(off) > 1))
    return words.mapInArrow(run, "w array<int>, count long")


def _top_pairs(words: DataFrame, names: Sequence[str], least: int, limit: int) -> list[tuple[int, int, int]]:
    """The ``limit`` most frequent pairs ``(key, n, places)``, ``places`` being
    how often they stand in different words; of equals, the first by
    the names of their symbols.  Keys are counted with symbols numbered in the
    order of their names, so Spark orders them by number."""
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.zeros(len(names), np.int64)
    place[order] = np.arange(len(names))

    def run(batches):
        for batch in batches:
            key, word = _pairs(*_symbols(batch.column(0)))
            d = pd.DataFrame({"key": place[key >> 32] << 32 | place[key & 0xFFFFFFFF],
                              "n": batch.column(1).to_numpy()[word], "places": 1}).groupby("key", as_index=False).sum()
            yield pa.RecordBatch.from_pandas(d.astype("int64"), preserve_index=False)

    top = (words.mapInArrow(run, "key long, n long, places long").groupBy("key")
           .agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
           .filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(limit).collect())
    return [(key_of(order[r["key"] >> 32], order[r["key"] & 0xFFFFFFFF]), r["n"], r["places"]) for r in top]


class MergeLoop:
    """Merges over a table ``words`` (w: symbol numbers, count) of symbols
    ``names``; ``joined`` spells what two symbols become."""

    def __init__(self, words: DataFrame, names: Sequence[str], joined: Callable[[str, str], str], min_frequency: int = 2,
                 top_pairs: int = TOP_PAIRS, epoch: int = EPOCH):
        self.words, self.names, self.joined = words, list(names), joined
        self.number = {c: i for i, c in enumerate(self.names)}
        self.least, self.top_pairs, self.epoch = max(1, min_frequency), top_pairs, epoch
        self.merges: list[tuple[str, str]] = []
        self.waiting: list[Merge] = []  # made since the index was written
        self.rounds = 0

    # -- what the driver holds --------------------------------------------------
    def _rank(self, key: int, n: int) -> tuple:
        return -n, self.names[key >> 32], self.names[key & 0xFFFFFFFF]

    def _set(self, key: int, n: int) -> None:
        """``key`` has the count ``n`` now; pairs behind the boundary are not held."""
        rank = self._rank(key, n)
        if rank < self.boundary:
            self.held[key] = n
            heapq.heappush(self.heap, (rank, key))
        else:
            self.held.pop(key, None)

    def _best(self, k: int) -> list[int]:
        """The next ``k`` pairs in order."""
        taken: list = []
        seen: set[int] = set()
        while self.heap and len(taken) < k:
            rank, key = heapq.heappop(self.heap)
            if key not in seen and self.held.get(key) == -rank[0]:
                taken.append((rank, key))
                seen.add(key)
        for entry in taken:
            heapq.heappush(self.heap, entry)
        return [key for _, key in taken]

    def _start_epoch(self) -> bool:
        """Count all pairs and write the index, if one is worth it; whether there is a pair."""
        if self.waiting:
            self.words, self.waiting = written(_merged(self.words, self.waiting), "bpe-words"), []
        top = _top_pairs(self.words, self.names, self.least, self.top_pairs + 1)
        self.boundary = (1 - self.least,)
        self.whole = len(top) <= self.top_pairs
        if not self.whole:
            self.boundary = self._rank(*top.pop()[:2])
        self.held, self.heap = {}, []
        for key, n, _ in top:
            self._set(key, n)
        self.first = {i: {i} for i in range(len(self.names))}
        self.last = {i: {i} for i in range(len(self.names))}
        if top:
            places = [p for _, _, p in top]
            scan = INDEX_SHARE * sum(places[:GUESSES]) > sum(places)
            self.index = (WordScan if scan else PairIndex)(self.words)
            some = self.words.orderBy(F.desc("count")).limit(GUESS_WORDS).toArrow().combine_chunks().to_batches()
            flat, off = _symbols(some[0].column(0))
            self.frequent = LinkedWords(flat, off, some[0].column(1).to_numpy(), [(i, 0, 0) for i in range(len(self.names))])
            self.most = min(self.epoch, SCAN_EPOCH) if scan else self.epoch
        return bool(top)

    def _keys(self, pairs: Iterable[int]) -> set[int]:
        """The pairs of the index that places of ``pairs`` had there."""
        return {key_of(x, y) for p in pairs for x in self.last[p >> 32] for y in self.first[p & 0xFFFFFFFF]}

    # -- a round -----------------------------------------------------------------
    def _guess(self, k: int) -> list[int]:
        """The next merges, if they change the counts as on the words that the
        driver holds.  Symbols that they make have the next numbers."""
        likely = {key: float(self.held[key]) for key in self._best(4 * k)}
        words, spelled, names = self.frequent.copy(), set(self.number), list(self.names)
        out: list[int] = []
        while likely and len(out) < k:
            key = max(likely, key=likely.__getitem__)  # of equals the first, as they are in order
            n, a, b = likely.pop(key), key >> 32, key & 0xFFFFFFFF
            name = self.joined(names[a], names[b])
            out.append(key)
            if n < self.least or name in spelled:
                break
            made = words.merge(a, b, len(names))
            spelled.add(name)
            names.append(name)
            if not made:
                continue
            keys, at = np.unique(made[0], return_inverse=True)
            change = np.zeros(len(keys), np.int64)
            np.add.at(change, at, made[1])
            share = n / -min(change[np.searchsorted(keys, key)], -1)
            for other, d in zip(keys.tolist(), (change * share).tolist()):
                if other in likely:
                    likely[other] += d
                elif d > 0 and other != key:
                    likely[other] = d
        return out

    def _round(self, guess: Sequence[int]) -> int:
        """Make the merges of ``guess`` up to the first that is not the next one."""
        steps, spelled, again = [], dict(self.number), []
        names = list(self.names)
        first, last = dict(self.first), dict(self.last)
        for i, key in enumerate(guess):
            a, b = key >> 32, key & 0xFFFFFFFF
            name = self.joined(names[a], names[b])
            if name in spelled:
                again.append(i)
            new = spelled.setdefault(name, len(names))
            if new == len(names):
                names.append(name)
            first[new], last[new] = first.get(new, set()) | first[a], last.get(new, set()) | last[b]
            steps.append((a, b, new))
        keys = {key_of(x, y) for p in guess for x in last[p >> 32] for y in first[p & 0xFFFFFFFF]}
        least = max(self.least, -self.boundary[0])
        found: dict[int, list] = {}
        for r in self.index.changes(keys, self.waiting, steps, least, again):
            found.setdefault(r["step"], []).append((r["key"], r["d"]))
        self.rounds += 1
        for i, (key, (a, b, new)) in enumerate(zip(guess, steps)):
            if self._best(1) != [key]:
                return i
            if new == len(self.names):
                self.names.append(self.joined(self.names[a], self.names[b]))
                self.number[self.names[new]] = new
                self.first[new], self.last[new] = set(), set()
            self.first[new] |= self.first[a]
            self.last[new] |= self.last[b]
            self.merges.append((self.names[a], self.names[b]))
            self.waiting.append((a, b, new))
            self.frequent.merge(a, b, new, counted=False)
            unknown = []
            for k, d in found.get(i, ()):
                if k in self.held:
                    self._set(k, self.held[k] + d)
                elif d > 0 and i in again:
                    unknown.append(k)
                elif d > 0:
                    self._set(k, d)
            if i in again:
                # pairs of an old symbol have risen; those that are not held are counted
                if unknown:
                    for k, n in self.index.totals(self._keys(unknown), self.waiting, unknown).items():
                        self._set(k, n)
                return i + 1
        return len(guess)

    def run(self, budget: int) -> list[tuple[str, str]]:
        """Up to ``budget`` merges (a, b)."""
        size = 8
        fresh = budget > 0 and self._start_epoch()
        while fresh and len(self.merges) < budget:
            if not self._best(1) or len(self.waiting) >= self.most:
                if self.whole and not self._best(1):
                    break
                fresh = self._start_epoch()
                continue
            made = self._round(self._guess(min(size, budget - len(self.merges), self.most - len(self.waiting))))
            size = max(4, min(GUESSES, 2 * made))
        return self.merges
