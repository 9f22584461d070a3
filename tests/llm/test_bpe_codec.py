import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_spark.llm import bpe_codec
from corpus_spark.llm.bpe_codec import ByteBpe, codec, digest_ids, encode_documents, op9_byte_bpe

from .conftest import HARD_TEXTS

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcthe' sdl1!?.\t \n\x1c　é́\U0001F600中")), max_size=120))
def test_equals_the_library(text):
    ids = codec(PATH, P.PATTERN).encode([text])[0].tolist()
    assert ids == TIK.encode_ordinary(text)
    assert codec(PATH, P.PATTERN).decode(ids) == text.encode()


def test_random_bytes_pieces():
    import random
    rnd = random.Random(5)
    bpe = ByteBpe(PATH, P.PATTERN)
    pieces = ["".join(rnd.choice("aehinorst") for _ in range(n)) for n in (3, 9, 40, 300, 1500, 2047, 2049, 9000)]
    got = bpe.encode_pieces([p.encode() for p in pieces])
    assert [got[p.encode()] for p in pieces] == [TIK.encode_ordinary(p) for p in pieces]
    for p in pieces[:6]:  # the heap of the longest pieces merges like the matrices
        assert bpe._merge_long(p.encode()) == got[p.encode()]


def digest(rows, docs):
    want = []
    for d, t in docs:
        ids = TIK.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_hard_texts_and_small_chunk_table(spark):
    docs = [(i, t) for i, t in enumerate(HARD_TEXTS)] + [(None, "no id"), (3, "again")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, ids string")
    digest(digest_ids(encode_documents(df, PATH, P.PATTERN), PATH, P.PATTERN).collect(), docs)
    assert digest_ids(encode_documents(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_chunk_table_is_emptied(monkeypatch):
    from corpus_spark.llm import tokenization
    monkeypatch.setattr(tokenization, "MAX_CHUNKS", 5)
    bpe = bpe_codec.ByteBpe(PATH, P.PATTERN)
    for t in HARD_TEXTS:
        assert bpe.encode([t or ""])[0].tolist() == TIK.encode_ordinary(t or "")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    digest(op9_byte_bpe(spark, d).collect(), docs)
