import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_spark.llm.packing import SEQUENCE, Places, op6_packing, pack_documents, pack_histogram, sequences
from corpus_spark.llm.tokenization import ChunkEncoder, _Library

from .conftest import HARD_TEXTS
from .test_token_blocks import whole

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_hold_every_piece_once(counts):
    patterns = pack_histogram(counts, 64)
    got = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 64 and list(lengths) == sorted(lengths, reverse=True)
        for x in lengths:
            got[x] += n
    assert got == Counter(counts) and len(patterns) <= 2 * len(counts) + 1
    places = Places(patterns)
    used = defaultdict(list)
    for length, n in counts.items():
        sequence, offset = places(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            used[s].append((o, length))
    assert set(used) == set(range(places.n_sequences))
    for parts in used.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 64


def test_shortest_pack_first():
    # 6 opens a pack, 5 another; 4 goes to the shorter one (5), then 3 to the pack with 6
    assert sorted(pack_histogram({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == [(1, (5, 4)), (1, (6, 3))]
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


def check(rows, docs, size=SEQUENCE):
    ids = {d: x + [2] for (d, _), x in zip(docs, whole([t for _, t in docs], PATH))}
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        packs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for group, end in ((pieces.items(), lambda k: len(ids[k])), (packs.items(), lambda k: size)):
        for k, parts in group:
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == end(k) if group is not packs.items() and end(k) != size else at <= end(k)
    return sum(map(len, ids.values())) / (size * len(packs))


def test_hard_texts_and_sequences(spark):
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, length int, part string")
    pieces, placed = pack_documents(df, PATH, size=100)
    rows = placed.collect()
    check(rows, docs, 100)
    ids = {d: x + [2] for (d, _), x in zip(docs, whole([t for _, t in docs], PATH))}
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        want[r.sequence_id] += ids[r.doc_id][r.start:r.start + r.length]
    got = {r.sequence_id: r for r in sequences(pieces, placed).collect()}
    assert {k: r.ids for k, r in got.items()} == want
    assert all(r.offsets[0] == 0 for r in got.values())
    _, placed = pack_documents(df.limit(0), PATH)
    assert placed.count() == 0


def test_texts_of_special_tokens_are_ordinary_whatever_stands_beside_them():
    ordinary = [f"plain words {i} here" for i in range(450)]
    odd = ["a <|startoftext|> b", "<|startoftext|>", "x<|endoftext|>y", "<|STARTOFTEXT|> <|startoftext|", "b" * 1500]
    for texts in (odd[:2] + ordinary, ordinary[:250] + odd + ordinary[250:], ordinary + odd[2:] + odd[:1]):
        ids, at = ChunkEncoder(_Library(PATH), False).encode(pa.array(texts, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == whole(texts, PATH)
    library, calls = _Library(PATH), []
    plain = library._plain

    class Counted:
        def encode_batch_fast(self, chunks, **kw):
            calls.extend(chunks)
            return plain.encode_batch_fast(chunks, **kw)
    library._plain = Counted()
    library(ordinary + odd)
    assert calls == [c for c in odd if c != odd[3]]  # not the ordinary ones


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert check(op6_packing(spark, d).collect(), docs) > 0.97
