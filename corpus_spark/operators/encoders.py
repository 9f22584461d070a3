"""Applying trained vocabularies: WordPiece (longest match) and unigram (most
probable segmentation), inside the scan.

Words are cut natively; the distinct words of an Arrow batch are encoded once,
all of them at the same time.  The vocabulary is a byte trie in flat arrays: one
sorted array of ``node * 256 + byte`` and the node each of them leads to.  It is
walked from all positions of all words at once, which gives the edges of every
word's lattice: (start, end, piece).

* WordPiece takes the longest edge at each position, from the trie of first
  pieces at the beginning of a word and from that of continuing pieces after it;
  a word that cannot be covered is one unknown piece.
* Unigram takes the path of highest score (Viterbi, over all words position by
  position); a character that no piece begins with costs ``UNKNOWN_PENALTY``
  below the least score, and unknown characters in a row are one unknown piece.

The flat arrays travel to the tasks once; they are as large as the vocabulary
that was asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import pretokenize

UNKNOWN_PENALTY = 10.0
#: Words of more characters are unknown to WordPiece.
MAX_WORD_CHARS = 100


class ByteTrie:
    """Pieces (UTF-8 strings, distinct, not empty) in flat arrays; ``find``
    walks all positions of a buffer at once."""

    def __init__(self, pieces: Sequence[str]):
        raw = [p.encode() for p in pieces]
        if not all(raw) or len(set(raw)) < len(raw):
            raise ValueError("pieces must be distinct and not empty")
        children: dict[int, int] = {}
        value: dict[int, int] = {}
        nodes = 1
        for number, piece in enumerate(raw):
            at = 0
            for byte in piece:
                key = at << 8 | byte
                if key not in children:
                    children[key] = nodes
                    nodes += 1
                at = children[key]
            value[at] = number
        self._keys = np.array(sorted(children), np.int64)
        self._to = np.array([children[k] for k in self._keys.tolist()], np.int64)
        self._value = np.full(nodes, -1, np.int64)
        self._value[list(value)] = list(value.values())
        self.longest = max(map(len, raw), default=0)

    def find(self, buf: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, piece)`` of all pieces that begin at one of
        ``starts`` and end at or before its limit, by length."""
        found = []
        node, at = np.zeros(len(starts), np.int64), starts
        for length in range(1, self.longest + 1):
            inside = at + length <= limits
            at, limits, node = at[inside], limits[inside], node[inside]
            if not len(at):
                break
            key = node << 8 | buf[at + length - 1]
            slot = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[slot] == key
            at, limits, node = at[hit], limits[hit], self._to[slot[hit]]
            whole = self._value[node]
            end = whole >= 0
            found.append((at[end], at[end] + length, whole[end]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of distinct words."""
    raw = words.cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def _char_starts(buf: np.ndarray) -> np.ndarray:
    return np.flatnonzero((buf & 0xC0) != 0x80)


@dataclass
class WordPiece:
    """``first``: ids of pieces that begin a word, ``rest``: of those (without
    their prefix) that continue one."""
    first: dict[str, int]
    rest: dict[str, int]
    unk_id: int
    max_chars: int = MAX_WORD_CHARS

    def __post_init__(self):
        self._tries = [(ByteTrie(list(p)), np.array(list(p.values()), np.int64)) for p in (self.first, self.rest)]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids on end, number of each word's)``."""
        buf, off = _words(words)
        n = len(words)
        longest, piece = [np.zeros(len(buf) + 1, np.int64) for _ in range(2)], [np.zeros(len(buf) + 1, np.int64) for _ in range(2)]
        chars = _char_starts(buf)
        end = np.repeat(off[1:], np.diff(off))
        some = off[:-1][np.diff(off) > 0]
        for k, (starts, (trie, ids)) in enumerate(zip((some, chars), self._tries)):
            s, e, p = trie.find(buf, starts, end[starts])
            longest[k][s] = e - s  # by length: the longest stands last
            piece[k][s] = ids[p]
        size = np.bincount(np.searchsorted(off, chars, side="right") - 1, minlength=n)
        bad = size > self.max_chars
        at, word, kind = off[:-1].copy(), np.arange(n), 0
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero(~bad & (np.diff(off) > 0))
        while len(alive):
            step = longest[kind][at[alive]]
            stuck = step == 0
            bad[alive[stuck]] = True
            alive, step = alive[~stuck], step[~stuck]
            taken.append((alive, piece[kind][at[alive]]))
            at[alive] += step
            alive = alive[at[alive] < off[alive + 1]]
            kind = 1
        word = np.concatenate([w for w, _ in taken] + [np.flatnonzero(bad)])
        ids = np.concatenate([p for _, p in taken] + [np.full(int(bad.sum()), self.unk_id)])
        turn = np.concatenate([np.full(len(w), i) for i, (w, _) in enumerate(taken)] + [np.full(int(bad.sum()), len(taken))])
        good = ~bad[word] | (turn == len(taken))
        word, ids, turn = word[good], ids[good], turn[good]
        order = np.lexsort((turn, word))
        return ids[order].astype(np.int64), np.bincount(word, minlength=n)


class Lattice:
    """Edges of the segmentation lattices of words under unigram scores."""

    def __init__(self, scores: dict[str, float]):
        self.pieces = list(scores)
        self.scores = np.array(list(scores.values()), float)
        self.trie = ByteTrie(self.pieces)
        self.unknown = (self.scores.min() if len(self.scores) else 0.0) - UNKNOWN_PENALTY

    def edges(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(start, end, piece, score)``; piece -1: a character that is not a piece."""
        chars = _char_starts(buf)
        limit = np.repeat(off[1:], np.diff(off))[chars] if len(chars) else chars
        start, end, piece = self.trie.find(buf, chars, limit)
        after = np.append(chars[1:], len(buf))
        single = np.zeros(len(buf) + 1, bool)
        single[start[end == np.append(after, 0)[np.searchsorted(chars, start)]]] = True
        lack = ~single[chars]
        start, end = np.append(start, chars[lack]), np.append(end, after[lack])
        score = np.append(self.scores[piece], np.full(int(lack.sum()), self.unknown))
        return start, end, np.append(piece, np.full(int(lack.sum()), -1)), score

    def best_paths(self, buf: np.ndarray, off: np.ndarray,
                   whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(word, piece, scores of words, back)`` along the best path of
        every word, in order; of equal paths the one whose last piece is
        longest, and so on towards the front.  Without ``whole`` no piece
        spans a word of several characters."""
        start, end, piece, score = self.edges(buf, off)
        word = np.searchsorted(off, start, side="right") - 1
        if not whole:
            chars = np.diff(np.append(0, np.cumsum((buf & 0xC0) != 0x80))[off])
            part = (end - start < np.diff(off)[word]) | (chars[word] == 1)
            start, end, piece, score, word = start[part], end[part], piece[part], score[part], word[part]
        inside = end - off[word]
        order = np.lexsort((start, end, inside))  # by end within the word, then the longest first
        start, end, piece, score = start[order], end[order], piece[order], score[order]
        best = np.full(len(buf) + len(off), -np.inf)  # node of a position: position + word, so words' borders differ
        shift = word[order]
        best[off[:-1] + np.arange(len(off) - 1)] = 0.0
        back = np.full(len(best), -1, np.int64)
        bounds = np.flatnonzero(np.diff(inside[order], prepend=-1))
        for a, b in zip(bounds.tolist(), np.append(bounds[1:], len(start)).tolist()):
            to, total = end[a:b] + shift[a:b], best[start[a:b] + shift[a:b]] + score[a:b]
            first = np.flatnonzero(np.diff(to, prepend=-1))  # edges with one end stand together
            top = np.maximum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, b - a))))
            hit = hit[np.flatnonzero(np.diff(to[hit], prepend=-1))]  # the longest of equals
            best[to[hit]] = total[hit]
            back[to[hit]] = a + hit
        n = len(off) - 1
        at, alive = off[1:] + np.arange(n), np.flatnonzero(np.diff(off) > 0)
        out = []
        while len(alive):
            edge = back[at[alive]]
            out.append((alive, edge))
            at[alive] = start[edge] + alive
            alive = alive[start[edge] > off[alive]]
        w = np.concatenate([x for x, _ in out[::-1]] + [np.zeros(0, np.int64)]).astype(np.int64)
        e = np.concatenate([x for _, x in out[::-1]] + [np.zeros(0, np.int64)]).astype(np.int64)
        stable = np.argsort(w, kind="stable")
        w, e = w[stable], e[stable]
        return w, piece[e], best[off[1:] + np.arange(n)], e


@dataclass
class Unigram:
    """``ids`` and ``scores`` (logarithms) of pieces."""
    ids: dict[str, int]
    scores: dict[str, float]
    unk_id: int

    def __post_init__(self):
        self._lattice = Lattice(self.scores)
        self._ids = np.array([self.ids[p] for p in self._lattice.pieces], np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids on end, number of each word's)``."""
        buf, off = _words(words)
        word, piece, _, _ = self._lattice.best_paths(buf, off)
        unknown = piece < 0
        again = np.zeros(len(word), bool)  # unknown characters in a row are one
        again[1:] = unknown[1:] & unknown[:-1] & (word[1:] == word[:-1])
        ids = np.where(unknown, self.unk_id, self._ids[piece] if len(self._ids) else self.unk_id)
        return ids[~again], np.bincount(word[~again], minlength=len(words))


def _encode_column(df: DataFrame, model: WordPiece | Unigram, id_col: str, words: Column) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array(
                [len(x) if x.is_valid else 0 for x in lists], np.int64)
            coded = lists.flatten().dictionary_encode()
            ids, each = shared.value.encode(coded.dictionary)
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts, lengths = (np.cumsum(each) - each)[which], each[which]
            total = np.cumsum(lengths)
            size = int(total[-1]) if len(total) else 0
            flat = ids[np.repeat(starts - (total - lengths), lengths) + np.arange(size)] if size else np.zeros(0, np.int64)
            first = np.cumsum(counts) - counts
            word = np.repeat(np.arange(len(which)) - np.repeat(first, counts), lengths)
            ends = np.append(0, total)[np.cumsum(np.append(0, counts))]
            at = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int64))),
                 pa.ListArray.from_arrays(at, pa.array(word.astype(np.int32)))], names=[id_col, "input_ids", "word_ids"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField("input_ids", T.ArrayType(T.LongType())),
                           T.StructField("word_ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, words.alias("words")).mapInArrow(run, schema)


def encode_wordpiece(df: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
                     pre: Sequence = ("whitespace",), prefix: str = "##", unk_id: int = 1, specials: Sequence[str] = (),
                     max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """``(id, input_ids, word_ids)``: words by longest match with the pieces
    of ``vocab`` (piece, id), those with ``prefix`` inside a word, the others at
    its beginning.  A word that cannot be covered, or of more than
    ``max_chars`` characters, is ``unk_id``.  ``specials`` are never matched in
    a text."""
    pieces = {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect() if r["piece"] not in set(specials)}
    model = WordPiece({p: i for p, i in pieces.items() if not (prefix and p.startswith(prefix))},
                      {p[len(prefix):]: i for p, i in pieces.items() if p.startswith(prefix) and len(p) > len(prefix)}, unk_id, max_chars)
    return _encode_column(df, model, id_col, pretokenize(F.col(text_col), pre))


def encode_unigram(df: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
                   pre: Sequence = ("whitespace",), unk_id: int = 1, specials: Sequence[str] = ()) -> DataFrame:
    """``(id, input_ids, word_ids)``: each word's segmentation of highest
    score under ``vocab`` (piece, id, score)."""
    rows = [r for r in vocab.select("piece", "id", "score").collect() if r["piece"] not in set(specials)]
    model = Unigram({r["piece"]: r["id"] for r in rows}, {r["piece"]: r["score"] for r in rows}, unk_id)
    return _encode_column(df, model, id_col, pretokenize(F.col(text_col), pre))


# --- back to text -------------------------------------------------------------------------

def decode_pieces(pieces: Column, kind: str, prefix: str = "##", suffix: str = "</w>", mark: str = "▁") -> Column:
    """The text of an array of pieces, natively: ``metaspace`` (``mark`` is a
    blank, the first one is dropped), ``bpe`` (``suffix`` ends a word),
    ``wordpiece`` (pieces with ``prefix`` go on, others follow a blank),
    ``byte_level`` (pieces hold their blanks)."""
    joined = F.array_join(pieces, "")
    if kind == "metaspace":
        spaced = F.replace(joined, F.lit(mark), F.lit(" "))
        return F.when(F.startswith(spaced, F.lit(" ")), F.substr(spaced, F.lit(2))).otherwise(spaced)
    if kind == "bpe":
        spaced = F.replace(joined, F.lit(suffix), F.lit(" "))
        return F.when(F.endswith(spaced, F.lit(" ")), F.left(spaced, F.length(spaced) - 1)).otherwise(spaced)
    if kind == "wordpiece":
        parts = F.transform(pieces, lambda p, i: F.when(
            F.startswith(p, F.lit(prefix)) & (F.length(p) > len(prefix)), F.substr(p, F.lit(len(prefix) + 1)))
            .when(i == 0, p).otherwise(F.concat(F.lit(" "), p)))
        return F.array_join(parts, "")
    if kind == "byte_level":
        return joined
    raise ValueError(f"Unknown decoder: {kind}")
