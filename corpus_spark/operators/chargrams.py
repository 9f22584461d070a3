"""Character n-grams as numbers, counted and looked up inside the scan.

An n-gram of up to three code points is one 63-bit number (21 bits a code
point), so a batch of texts is counted or scored by array operations, and no
n-gram becomes a row of its own.  Texts are taken in slices of bounded size
(a single longer text is a slice of its own).
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest n-gram that fits a signed 64-bit number.
MAX_N = 3
_BITS = 21
SLICE_CHARS = 1 << 20
#: Different (language, n-gram) pairs a task counts before it hands them on.
COUNTED = 1 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges ``(from, to)`` of rows with about ``SLICE_CHARS`` characters."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield at, to
        at = to


def grams_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and the row of each."""
    texts = pc.fill_null(texts, "")
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    per = np.maximum(size - (n - 1), 0)
    row = np.repeat(np.arange(len(size)), per)
    # texts shorter than an n-gram have none, all others lose their last n - 1 positions
    first = np.arange(len(row)) + ((np.cumsum(size) - size) - (np.cumsum(per) - per))[row]
    key = codes[first]
    for j in range(1, n):
        key = (key << _BITS) | codes[first + j]
    return key, row


def spelled(keys: np.ndarray, n: int) -> list[str]:
    """The n-grams of numbers, their characters joined by a space."""
    wide = np.full((len(keys), 2 * n - 1), ord(" "), "<u4")
    for j in range(n):
        wide[:, 2 * j] = (keys >> (_BITS * (n - 1 - j))) & ((1 << _BITS) - 1)
    flat, w = wide.tobytes().decode("utf-32-le"), 2 * n - 1
    return [flat[i:i + w] for i in range(0, len(flat), w)]


def numbered(grams: list[str], n: int) -> np.ndarray:
    """Numbers of n-grams as :func:`spelled` writes them."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 2 * n - 1)
    key = np.zeros(len(codes), np.int64)
    for j in range(n):
        key = (key << _BITS) | codes[:, 2 * j]
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return keys, counts


def counter(n: int, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (group, text): rows (group, gram, c) of one
    task, a pair as a rule once."""
    def run(batches):
        held: dict = {}

        def out():
            for group, parts in held.items():
                keys, counts = _merged(parts)
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group] * len(part), schema.types[0]), pa.array(spelled(part, n), schema.types[1]),
                         pa.array(counts[i:i + (1 << 16)], schema.types[2])], schema=schema)
            held.clear()

        for batch in batches:
            for a, b in slices(batch.column(1)):
                key, row = grams_of(batch.column(1)[a:b], n)
                groups = batch.column(0)[a:b].dictionary_encode()
                of = groups.indices.to_numpy(zero_copy_only=False)[row]
                for g, group in enumerate(groups.dictionary.to_pylist()):
                    held.setdefault(group, []).append(np.unique(key[of == g], return_counts=True))
                if sum(len(k) for parts in held.values() for k, _ in parts) > COUNTED:
                    for group, parts in held.items():
                        held[group] = [_merged(parts)]
                    if sum(len(parts[0][0]) for parts in held.values()) > COUNTED // 2:
                        yield from out()
        yield from out()
    return run


class Profiles:
    """Log-probabilities of n-grams in some languages, as sorted arrays.  What
    a language lacks has its smallest logp.  ``whole``: no n-gram is left out."""

    def __init__(self, table: pa.Table, floors: dict[str, float], n: int, whole: bool) -> None:
        self.n, self.whole, self.languages = n, whole, sorted(floors)
        grams = table.column("gram").to_pylist()
        fit = np.array([len(g) == 2 * n - 1 for g in grams], bool)
        key = numbered([g for g, ok in zip(grams, fit) if ok], n)
        self.keys, at = np.unique(key, return_inverse=True)
        language = pc.index_in(table.column("language").combine_chunks(), pa.array(self.languages)).to_numpy()[fit]
        logp = table.column("logp").to_numpy()[fit]
        self.floor = np.array([floors[x] for x in self.languages])
        self.gain = np.zeros((len(self.languages), len(self.keys)))
        self.has = np.zeros((len(self.languages), len(self.keys)))
        self.gain[language, at] = logp - self.floor[language]
        self.has[language, at] = 1

    def best(self, lines: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The most likely language of each line (None: none of its n-grams is
        here; of equals the last in order), and whether that is settled."""
        key, row = grams_of(lines, self.n)
        size = np.bincount(row, minlength=len(lines))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        known = np.bincount(row[hit], minlength=len(lines))
        at, row = at[hit], row[hit]
        top, pred = np.full(len(lines), -np.inf), np.full(len(lines), -1)
        for i, floor in enumerate(self.floor):
            some = np.bincount(row, weights=self.has[i][at], minlength=len(lines)) > 0
            score = np.bincount(row, weights=self.gain[i][at], minlength=len(lines)) + size * floor
            better = some & (score >= top)
            top[better], pred[better] = score[better], i
        return [self.languages[i] if i >= 0 else None for i in pred], (known == size) | self.whole


def line_scorer(profiles, schema: pa.Schema) -> Callable:
    """For ``mapInArrow`` over (id, lines, lower-cased lines): rows (id, lines,
    preds, settled); ``profiles`` is a broadcast :class:`Profiles`."""
    def run(batches):
        for batch in batches:
            low = batch.column(2)
            flat = low.flatten()
            preds, settled = [], []
            for a, b in slices(flat):
                p, s = profiles.value.best(flat[a:b])
                preds += p
                settled.append(s)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(low).to_numpy(zero_copy_only=False))]).astype(np.int32)
            done = np.concatenate(settled) if settled else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(preds, pa.string())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(done, pa.bool_()))], names=schema.names)
    return run
