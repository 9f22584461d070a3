"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pieces of the texts are laid out as rows of padded matrices, one for
each bucket of lengths.  In every round each row merges its leftmost pair of
least rank; pair ranks come from an open-addressing hash table over all pairs
of tokens whose bytes form a token; the merged column is closed up, and rows
without a further merge leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices
from .tokenization import ID_TYPE, ChunkEncoder

NO_RANK = np.int32(2**31 - 1)
_ID_BITS = 21
#: Matrices hold at most this many cells.
MATRIX_CELLS = 1 << 20
#: Pieces of more bytes would need as many rounds over as many columns; they
#: are merged, with the same result, in a heap of pairs.
LONGEST_ROW = 2048


class PairRanks:
    """Hash table ``(left id, right id) -> rank`` with vectorised look-up."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << _ID_BITS | ranks[t[i:]], r)
                 for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([r for _, r in pairs], np.int32)
        self._mask = (1 << max(4, int(4 * len(keys)).bit_length())) - 1
        self._keys = np.full(self._mask + 1, -1, np.int64)
        self._values = np.full(self._mask + 1, NO_RANK, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of the keys that want it, the others step on
            free = left[self._keys[slot[left]] < 0]
            self._keys[slot[free]] = keys[free]
            left = left[self._keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self._mask
        at = self._slot(keys)
        while (off := self._keys[at] != keys).any():
            at[off] = (at[off] + 1) & self._mask
        self._values[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self._mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NO_RANK`` where none; a negative id is padding."""
        keys = (left.astype(np.int64) << _ID_BITS) | right
        pad = (left < 0) | (right < 0)
        keys[pad] = 0
        slot = self._slot(keys.ravel()).reshape(keys.shape)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], NO_RANK)
        todo = np.flatnonzero(((found != keys) & (found >= 0)).ravel())
        flat, wanted, place = out.ravel(), keys.ravel(), slot.ravel()
        at = place[todo]
        while len(todo):
            at = (at + 1) & self._mask
            here = self._keys[at]
            hit = here == wanted[todo]
            flat[todo[hit]] = self._values[at[hit]]
            on = ~hit & (here >= 0)
            todo, at = todo[on], at[on]
        out = flat.reshape(out.shape)
        out[pad] = NO_RANK
        return out


class ByteBpe:
    """Encoder and decoder of a rank file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        if max(self.ranks.values()) >= 1 << _ID_BITS:
            raise ValueError(f"ranks must be below {1 << _ID_BITS}")
        self.token = {r: t for t, r in self.ranks.items()}
        self.pair_ranks = PairRanks(self.ranks)
        self._byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # \\s as the Unicode property, which is what rank files' own libraries use
        self._pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._chunks = ChunkEncoder(self.encode_chunks, spaces_dropped=False)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all strings on end, number of each)``."""
        cut = [[p.encode() for p in self._pieces(c)] for c in chunks]
        known = self.encode_pieces(list(dict.fromkeys(p for c in cut for p in c)))
        ids = np.fromiter((i for c in cut for p in c for i in known[p]), ID_TYPE)
        return ids, np.array([sum(len(known[p]) for p in c) for c in cut])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts on end, offsets)``; a null text is empty."""
        return self._chunks.encode(texts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[at[i]:at[i + 1]] for i in range(len(texts))]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pieces; a piece that is a token is that token."""
        out = {p: [self.ranks[p]] for p in pieces if p in self.ranks}
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            if p and p not in out:
                if len(p) > LONGEST_ROW:
                    out[p] = self._merge_long(p)
                else:
                    width = len(p) + 3 & ~3 if len(p) <= 32 else 1 << (len(p) - 1).bit_length()
                    buckets.setdefault(width, []).append(p)
        for width, rows in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                out.update(zip(part, self._merge_rows(part, width)))
        return out

    def _merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        lengths = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < lengths[:, None], self._byte_ids[raw], np.int32(-1))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        names = np.arange(len(rows))
        done: list[list[int]] = [[]] * len(rows)
        while len(names):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(names), np.int64)
            every = np.arange(len(names))
            best = ranks[every, at] if ranks.shape[1] else np.full(len(names), NO_RANK)
            ended = best == NO_RANK
            if ended.any():
                for name, row in zip(names[ended].tolist(), ids[ended]):
                    done[name] = row[row >= 0].tolist()
                go = ~ended
                ids, ranks, names, at, best = ids[go], ranks[go], names[go], at[go], best[go]
                every = np.arange(len(names))
                if not len(names):
                    break
            ids[every, at] = best  # a token's id is its rank
            n, columns = ids.shape
            keep = np.ones((n, columns), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, columns - 1)
            keep = np.ones((n, columns - 1), bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, columns - 2)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pair_ranks(ids[some, at[some] - 1], ids[some, at[some]])
            some = np.flatnonzero(at < columns - 2)
            ranks[some, at[some]] = self.pair_ranks(ids[some, at[some]], ids[some, at[some] + 1])
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece: linked tokens and a heap
        of (rank, place), leftmost first among equals."""
        ids = self._byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        parts: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
        after = list(range(1, len(piece) + 1))
        before = list(range(-1, len(piece) - 1))
        now = dict((i, r) for r, i in heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            now.pop(j, None)
            after[i] = after[j]
            if after[j] < len(piece):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    now.pop(k, None)
                    if after[k] < len(piece) and (r := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                        now[k] = r
                        heapq.heappush(heap, (r, k))
        return [self.ranks[p] for p in parts if p is not None]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids; an id that the file lacks is a ``KeyError``."""
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) -> doc_id and ids
    (array of int), one row per row.  Null and empty texts have no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, at = bpe.encode_array(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digest_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Decode ids and digest both sides: doc_id, n_tokens, ids_sha256 (decimal
    ids joined by commas), decoded_sha256 (the decoded bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        decimal = {r: str(r) for r in bpe.token}
        for batch in batches:
            sha, back, counts = [], [], []
            for row in batch.column(1):
                ids = row.values.to_pylist() if row.is_valid else []
                counts.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, digest both."""
    import public_tokenizers
    from .common import documents
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digest_ids(encode_documents(documents(spark, sf_dir), path, pattern), path, pattern)
