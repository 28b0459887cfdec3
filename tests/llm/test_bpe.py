import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from polystrata.llm.bpe import ByteBPE, Memo, PerfectHash, digest_documents, encode_documents


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aeth n'sEé²½\x85\xa0\x1c\t\n019."), st.text(alphabet=st.characters(max_codepoint=255))))
def test_as_the_library(bpe, oracle, text):
    ids = bpe.encode(text)
    assert ids == oracle.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_long_runs(bpe, oracle):
    for t in ("a" * 30000, " " * 5000 + "x", "<|endoftext|>", "é" * 4000, "0123456789" * 300):
        assert bpe.encode(t) == oracle.encode_ordinary(t)


def test_perfect_hash():
    keys = [b"k%d" % i for i in range(3000)]
    h = PerfectHash(keys, list(range(3000)))
    assert [h.get(k) for k in keys] == list(range(3000)) and None not in h.keys
    assert h.get(b"stranger") is None and PerfectHash([], []).get(b"x") is None


def test_memo_is_bounded():
    m = Memo(len, 10)
    assert [m["x" * i] for i in range(50)] == list(range(50)) and len(m) <= 10 and len(m.old) <= 10


def test_documents(spark, small, oracle):
    v = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = oracle.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in digest_documents(docs, *v).collect()} == want
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "hi there", "c")], "doc_id long, text string, token_ids string")
    assert sorted((r.n_tokens, r.token_ids) for r in encode_documents(odd, *v).collect()) == [(0, []), (0, []), (2, oracle.encode_ordinary("hi there"))]
    assert encode_documents(odd.limit(0), *v).collect() == []
