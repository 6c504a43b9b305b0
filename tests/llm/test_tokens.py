import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkweave.llm import byte_pair_codec as B
from sparkweave.llm import token_counts as C

from .fixtures import awkward, empty, wider

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return C.Counter(JSON, PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_codec_is_the_library(codec, library, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(st.text(max_size=40), st.just("<|endoftext|>"), st.just("  \n don't stop"), st.just("aaaa" * 30)), max_size=8))
def test_counter_is_the_library(counter, tokenizer, parts):
    text = "".join(parts)
    assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_model_is_serialised_as_stated(codec):
    assert codec.model.id_to_piece(5) == B.as_letters(codec.pieces[5])
    assert codec.model.get_score(7) == -7
    assert all(B.as_bytes(B.as_letters(bytes([b]))) == bytes([b]) for b in range(256))


def test_incomplete_vocabulary():
    with pytest.raises(ValueError):
        B.serialise_model({b"a": 0})
    with pytest.raises(ValueError):
        B.serialise_model({b"a": 0, b"b": 2})


def test_proven_words(counter, tokenizer):
    for word in list(counter.whole)[::500]:
        assert len(tokenizer.encode(word, add_special_tokens=False).ids) == 1


def test_memo_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(B, "MEMO_ENTRIES", 10)
    for i in range(50):
        codec.encode(f"qzx{i}vw kjq{i}")
    assert len(codec.memo) < 40


@pytest.mark.parametrize("change", [lambda d: d, wider])
def test_awkward_documents(spark, library, tokenizer, change):
    rows = change(awkward(spark))
    key = lambda r: (r.doc_id is None, r.doc_id, r.ids_sha256)
    want = []
    for r in awkward(spark).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = B.encode_documents(rows, RANKS, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    counts = C.count_tokens(rows, JSON, PATTERN).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in awkward(spark).collect()]
    assert sorted(map(tuple, counts), key=str) == sorted(want, key=str)


def test_ids_come_along(spark, library):
    row = B.encode_documents(spark.createDataFrame([(1, "to be or not")], "doc_id long, text string"), RANKS, PATTERN, with_ids=True).first()
    assert row.ids == library.encode_ordinary("to be or not")


def test_empty_tables(spark):
    assert B.encode_documents(empty(spark), RANKS, PATTERN).count() == 0
    assert C.count_tokens(empty(spark), JSON, PATTERN).count() == 0
