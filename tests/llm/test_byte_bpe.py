import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trialmill.llm import byte_bpe, queries

PATH, PATTERN = byte_bpe.public_vocabulary(queries.VOCABULARY)
RANKS = byte_bpe.read_ranks(PATH)
CODEC = byte_bpe.Codec(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


TEXTS = st.one_of(
    st.text(max_size=200),
    st.text(alphabet="ab '\n\tlvres!?1é日", max_size=120),
    st.builds(lambda a, n: a * n, st.text(min_size=1, max_size=4), st.integers(1, 60)),
)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encodes_as_the_library(library, text):
    ids = CODEC.encode(text)
    assert ids == library.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\tlvres!?1é日", max_size=150), st.integers(1, 9))
def test_splits_do_not_depend_on_the_cut(text, leaf):
    old = byte_bpe.LEAF_CHARS
    byte_bpe.LEAF_CHARS = leaf
    try:
        assert CODEC.pieces(text) == CODEC.pattern.findall(text)
    finally:
        byte_bpe.LEAF_CHARS = old


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60))
def test_joining_halves_is_merging_the_whole(data, cut):
    assert CODEC.join(CODEC._merged(data[:cut]), CODEC._merged(data[cut:])) == CODEC._merged(data)


def test_hard_rows(spark, docs, library):
    long = "aé" * 40_000 + " " * 70_000 + "don't stop! " * 9_000 + "x" * 50_000
    rows = [(1, None, "s"), (2, "", None), (3, "<|endoftext|>", "s"), (4, long, "s"), (4, long, "s"), (None, "ok", "s"), (5, " \n\n x\r\n", "s")]
    out = byte_bpe.decode(byte_bpe.encode(docs(rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.bucket == "y"
    assert byte_bpe.encode(docs([]), PATH, PATTERN).count() == 0


def test_given_documents(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op10_byte_bpe(spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
