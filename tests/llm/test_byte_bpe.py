import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strata.llm import byte_bpe, queries

TEXTS = [
    None, "", " ", "  \n\t ", "it's WE'LL '' ''s 'x", "\u3000 x  y\r\n\n  z", "\U0001f600\U0001f600 naïve 123½ ① \U0001d400\U0001d400", "x\x1cy\x85z\xa0 ",
    "a" * 500, "ab" * 3000, "the theory of everything", "the theory of everything", "\n\n\na  b", "ß\u0301\u200b\ufeff",
]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("encode", [byte_bpe.encode, byte_bpe.encode_sql])
def test_as_the_library_does(frame, ranks, library, encode):
    docs = frame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in byte_bpe.decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, np.uint32).tolist() == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_heap_is_fold(ranks):
    for w in (b"hello", b"aaaaaaaaaaaaaaa", "данные".encode(), b"zqxjkvb" * 5, b"\xff\xfe"):
        merged = byte_bpe.merge_word(w, ranks)
        assert merged == byte_bpe.merge_heap(w, ranks)


def test_empty_table(frame, ranks):
    docs = frame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_query_is_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text), "<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_very_long_texts(frame, ranks, library):
    texts = ["ab " * 400_000, "\u00e9" * 300_000, " " * 500_000 + "x", "1" * 100_001]
    docs = frame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        if r.doc_id != 1:
            assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode_ordinary(texts[r.doc_id])
