"""Encoding whole texts with a public tokenizer file inside Spark tasks.

A text is cut where no token can cross (before a blank or line feed that
follows a visible character), each distinct chunk is encoded once, and the ids
of the text are the ids of its chunks on end.  A text in which such a cut
would not be safe is encoded whole.  A worker keeps the ids of the chunks it
has met in numpy arrays of a fixed size under 64-bit hashes of their bytes.
Chunks are looked up in windows, and the arrays are emptied before a window
could overfill them, so memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import gather, hash_spans, text_buffer

ID_TYPE = np.dtype("<u4")
#: Chunks and ids that a worker keeps.
MAX_CHUNKS = 1 << 21
MAX_IDS = 1 << 23
#: Strings encoded at a time.
STRINGS = 4000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x0A]] = True
#: Marks that no rule of a tokenizer joins to the letter before them.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class _Table:
    """Open-addressing hash table of a fixed size: 64-bit key -> range of a
    pool of ids.  At most half of its slots are used."""

    def __init__(self, most: int):
        self.most = most
        self._mask = (1 << (2 * most - 1).bit_length()) - 1
        self._key = np.zeros(self._mask + 1, np.uint64)
        self._start = np.zeros(self._mask + 1, np.int32)
        self._length = np.zeros(self._mask + 1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self._pool = np.zeros(1 << 12, ID_TYPE)
        self._start.fill(-1)

    def _place(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        slot, left = (keys & np.uint64(self._mask)).astype(np.int64), np.arange(len(keys))
        while len(left):  # of the keys that want a free slot one gets it, the others step on
            at = slot[left]
            free = left[self._start[at] < 0]
            self._key[slot[free]] = keys[free]
            self._start[slot[free]] = starts[free]
            self._length[slot[free]] = lengths[free]
            left = left[self._key[at] != keys[left]]
            slot[left] = (slot[left] + 1) & self._mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where absent."""
        slot = (keys & np.uint64(self._mask)).astype(np.int64)
        free = self._start[slot] < 0
        hit = (self._key[slot] == keys) & ~free
        out = np.where(hit, slot, -1)
        todo = np.flatnonzero(~hit & ~free)
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self._mask
            free = self._start[at] < 0
            hit = (self._key[at] == keys[todo]) & ~free
            out[todo[hit]] = at[hit]
            on = ~hit & ~free
            todo, at = todo[on], at[on]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New distinct keys with the ids of each on end; no more than there is room for."""
        if self.n + len(keys) > self.most:
            raise ValueError(f"{self.n + len(keys)} chunks in a table of {self.most}")
        if self.used + len(ids) > len(self._pool):
            self._pool = np.concatenate((self._pool[:self.used], ids, np.zeros(self.used + len(ids), ID_TYPE)))
        else:
            self._pool[self.used:self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self._place(keys, starts.astype(np.int32), lengths.astype(np.int32))
        self.n += len(keys)
        self.used += len(ids)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids on end, number of each)``; slot -1 has none."""
        lengths = np.where(slots >= 0, self._length[slots], 0)
        return gather(self._pool, self._start[slots].astype(np.int64), lengths), lengths


class ChunkEncoder:
    """Ids of whole texts from ids of their chunks.

    ``spaces_dropped``: the tokenizer drops white space before anything else
    looks at it, so every blank is a safe cut.  Otherwise (byte-level BPE) a
    cut is safe where visible characters meet a blank or line feed.
    ``encode_chunks`` turns a list of distinct strings into their ids on end
    and the number of each.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaces_dropped: bool):
        self._encode_chunks = encode_chunks
        self._spaces_dropped = spaces_dropped
        self._table = _Table(MAX_CHUNKS)

    def _spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        separator = _SEPARATOR[buf]
        begin = ~separator if self._spaces_dropped else separator.copy()
        begin[1:] &= separator[:-1] if self._spaces_dropped else ~separator[:-1]
        border = offsets[:-1][np.diff(offsets) > 0]
        if not self._spaces_dropped:
            begin[border] = True
            starts = np.flatnonzero(begin)
            return starts, np.append(starts[1:], len(buf))
        begin[border] = ~separator[border]
        starts = np.flatnonzero(begin)
        stop = ~separator
        stop[:-1] &= separator[1:]
        stop[border[1:] - 1] = ~separator[border[1:] - 1]
        return starts, np.flatnonzero(stop) + 1

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode new chunks (distinct keys, not in the table).  A chunk that
        ends in white space other than a blank or line feed is left out: the
        run may go on in the chunk behind it."""
        raw = buf.tobytes()
        # a letter and a mark behind it are never in one token: such a chunk has the ids of its two parts
        tailed = (ends - starts > 1) & _MARK[buf[ends - 1]]
        tailed[tailed] = _LETTER[buf[ends[tailed] - 2]]
        s = np.concatenate((starts[~tailed], starts[tailed], ends[tailed] - 1))
        e = np.concatenate((ends[~tailed], ends[tailed] - 1, ends[tailed]))
        k = np.concatenate((keys[~tailed], hash_spans(buf, starts[tailed], ends[tailed] - 1),
                            hash_spans(buf, ends[tailed] - 1, ends[tailed])))
        new, at = np.unique(k, return_index=True)
        at = at[self._table.find(new) < 0]
        strings = [raw[i:j].decode("utf-8") for i, j in zip(s[at].tolist(), e[at].tolist())]
        if not self._spaces_dropped:
            safe = [not (c[-1].isspace() and c[-1] not in " \n") for c in strings]
            strings = [c for c, ok in zip(strings, safe) if ok]
            at = at[safe]
        for i in range(0, len(strings), STRINGS):
            self._table.add(k[at[i:i + STRINGS]], *self._encode_chunks(strings[i:i + STRINGS]))
        if tailed.any():
            head, mark = (self._table.find(hash_spans(buf, a, b)) for a, b in
                          ((starts[tailed], ends[tailed] - 1), (ends[tailed] - 1, ends[tailed])))
            ids, lengths = self._table.ids(np.stack((head, mark), axis=1).ravel())
            fresh = keys[tailed]
            self._table.add(fresh, ids, lengths.reshape(-1, 2).sum(axis=1))

    def _window(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids on end, number of each, whether it is known)`` of chunks."""
        keys = hash_spans(buf, starts, ends)
        slots = self._table.find(keys)
        lacking = np.flatnonzero(slots < 0)
        if len(lacking):
            new, at = np.unique(keys[lacking], return_index=True)
            if self._table.n + 3 * len(new) > self._table.most or self._table.used > MAX_IDS:
                self._table.clear()
                lacking = np.arange(len(keys))
                new, at = np.unique(keys, return_index=True)
            at = lacking[np.sort(at)]
            self._learn(buf, starts[at], ends[at], keys[at])
            slots = self._table.find(keys)
        return *self._table.ids(slots), slots >= 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts on end, offsets)``; a null text is empty."""
        buf, offsets = text_buffer(texts)
        starts, ends = self._spans(buf, offsets)
        if not len(starts):
            return np.zeros(0, ID_TYPE), np.zeros(len(offsets), np.int64)
        step = max(1, self._table.most // 4)  # a new chunk adds three at most: itself and its two parts
        parts = [self._window(buf, starts[i:i + step], ends[i:i + step]) for i in range(0, len(starts), step)]
        ids, lengths, known = (np.concatenate(x) for x in zip(*parts))
        first = np.searchsorted(starts, offsets)
        bounds = np.concatenate(([0], np.cumsum(lengths)))[first]
        if not known.all():  # texts that cannot be cut are encoded whole
            whole = np.unique(np.searchsorted(first, np.flatnonzero(~known), side="right") - 1)
            parts = [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            for i in whole.tolist():
                parts[i] = self._encode_chunks([buf[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8")])[0]
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            ids = np.concatenate(parts)
        return ids, bounds.astype(np.int64)


class _Library:
    """The ``tokenizers`` library on many short strings: they are joined by a
    special token of the file, which is cut off before anything else, and the
    ids are split at it again.  Long strings and those that hold the text of
    any special token are encoded one by one, as ordinary text, whatever
    stands beside them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self._joined = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self._joined.get_added_tokens_decoder().items() if t.special]
        self._id, self._mark = special[-1] if special else (None, None)
        self._special = np.array([i for i, _ in special], ID_TYPE)
        self._holds = re.compile("|".join(re.escape(c) for _, c in special)).search

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        pool, used = [], 0
        joined = np.zeros(len(chunks), bool)
        if self._mark and len(chunks) > 1:
            joined = np.array([len(c) <= 1000 and not self._holds(c) for c in chunks])
        at = np.flatnonzero(joined)
        groups = [at[i:i + 200] for i in range(0, len(at), 200)]
        texts = [self._mark.join([chunks[i] for i in g.tolist()]) + self._mark for g in groups]
        for g, e in zip(groups, self._joined.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            ids = np.array(e.ids, ID_TYPE)
            ends = np.flatnonzero(ids == self._id)
            if len(ends) != len(g):  # the mark came out of a chunk (as its unknown token, or after normalising)
                joined[g] = False
                continue
            odd = np.flatnonzero(np.isin(ids, self._special) & (ids != self._id))
            joined[g[np.searchsorted(ends, odd)]] = False
            lengths[g] = np.diff(ends, prepend=-1) - 1
            starts[g] = used + ends - lengths[g]
            pool.append(ids)
            used += len(ids)
        alone = np.flatnonzero(~joined)
        done = [np.array(e.ids, ID_TYPE) for e in self._plain.encode_batch_fast(
            [chunks[i] for i in alone.tolist()], add_special_tokens=False)] if len(alone) else []
        lengths[alone] = [len(x) for x in done]
        starts[alone] = used + np.cumsum(lengths[alone]) - lengths[alone]
        return gather(np.concatenate([*pool, *done, np.zeros(0, ID_TYPE)]), starts, lengths), lengths


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaces_dropped: bool) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    key = (path, spaces_dropped)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(_Library(path), spaces_dropped)
    return _encoders[key]


def encode_column(texts: pa.Array, path: str, spaces_dropped: bool, end_id: int) -> list[np.ndarray]:
    """Ids of each text (null: empty) with ``end_id`` after them."""
    ids, offsets = encoder(path, spaces_dropped).encode(texts)
    whole = np.insert(ids, offsets[1:], ID_TYPE.type(end_id))
    at = offsets + np.arange(len(offsets))
    return [whole[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
