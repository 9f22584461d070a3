import functools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpus_spark.llm.token_blocks import (Segment, op1_token_blocks, pack_segment, read_token_blocks,
                                           write_token_blocks)
from corpus_spark.llm.tokenization import encoder

from .conftest import HARD_TEXTS

PATH = P.path("byte_bpe_50k.json")


@functools.cache
def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(texts, path=PATH):
    t = tokenizer(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=5),
       st.sampled_from([8, 64, 256]), st.sampled_from([0.5, 0.9, 1.0]))
def test_segment_round_trip(docs, block, percentile):
    ids = np.array([i for d in docs for i in d], np.uint32)
    s = Segment(pack_segment(list(range(len(docs))), [len(d) for d in docs], ids, block, percentile))
    assert [x.tolist() for _, _, x in s.documents()] == docs
    n = len(ids)
    assert s.ids(n // 3, n // 2).tolist() == ids[n // 3:n // 2].tolist()


def test_bad_parameters():
    with pytest.raises(ValueError):
        pack_segment([], [], np.zeros(0, np.uint32), block_size=12)
    with pytest.raises(ValueError):
        pack_segment([], [], np.zeros(0, np.uint32), percentile=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sS1!.\t \n \x1c　é́\U0001F600")), max_size=40),
                max_size=4))
def test_chunked_encoding_is_whole_encoding(texts):
    for path, dropped in ((PATH, False), (P.path("word_bpe_49k.json"), True)):
        ids, at = encoder(path, dropped).encode(pa.array(texts, pa.string()))
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == whole(texts, path)


def check(rows, docs):
    ids = [x + [2] for x in whole([t for _, t in docs])]
    start = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    want = [(d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(docs, start, ids)]
    assert [tuple(r)[:4] for r in rows] == want


def test_blocks_of_hard_texts(spark, tmp_path):
    docs = [(7 * i - 20, t) for i, t in enumerate(HARD_TEXTS)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in reversed(docs)],
                               "doc_id long, text string, start string, shard int")
    write_token_blocks(df, str(tmp_path / "b"), PATH, segment_ids=50)
    out = read_token_blocks(spark, str(tmp_path / "b"))
    check(out.orderBy("start").collect(), docs)


def test_null_ids_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (1, None), (1, "a a")], "doc_id long, text string")
    write_token_blocks(df, str(tmp_path / "a"), PATH)
    rows = read_token_blocks(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1] and sorted(r.n_tokens for r in rows) == [1, 2, 3]
    write_token_blocks(df.limit(0), str(tmp_path / "e"), PATH)
    assert read_token_blocks(spark, str(tmp_path / "e")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check(op1_token_blocks(spark, d).orderBy("start").collect(), docs)
