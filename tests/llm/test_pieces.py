import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm.pieces import PieceCoder, default_vocabulary, encode_pieces

CODER = PieceCoder(default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab é.▁ \n\t\x00the中😀ﬁ́<s>"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_equals_the_library(texts):
    for (n, ids, decoded), told in zip(CODER.encode(texts), CODER.library.encode(texts)):
        assert ids == b",".join(b"%d" % i for i in told) and n == len(told)
        assert decoded == CODER.library.decode(told)


@pytest.mark.parametrize("text", [" ", "   ", " a", "a ", "a  b", "▁▁", "<s>x</s>", "a" * 3000, "中文" * 2000, "\n\n \n", "of.\nThe, (x)"])
def test_merge_equals_the_library(text):
    (n, ids, decoded), told = CODER.encode([text])[0], CODER.library.encode(text)
    assert [int(i) for i in ids.split(b",")] == told and decoded == CODER.library.decode(told)


def test_operator(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [None, "", "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in encode_pieces(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        told = CODER.library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(told), told, CODER.library.decode(told))
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, told)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(CODER.library.decode(told).encode()).hexdigest()


def test_empty_table(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_difference_is_an_error(monkeypatch):
    coder = PieceCoder(default_vocabulary())
    monkeypatch.setattr(coder, "merge", lambda text: [5])
    with pytest.raises(ValueError, match="library"):
        coder.encode(["word"])
