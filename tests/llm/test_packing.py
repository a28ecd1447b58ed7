import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import packing
from pairloom.llm.packing import WordEncoder, default_vocabulary, pack, pack_documents

ENCODER = WordEncoder(default_vocabulary())


def truth(text):
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def ours(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aéßÇ ñ\t\n\x0b\x1c\x85\xa0.,'!*#<|>İΣςǅﬁ́³½1"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_ids_equal_the_library(texts):
    assert ours(texts) == [truth(t) for t in texts]


def test_ids_of_hard_words():
    texts = ["a<|endoftext|>b", "<|startoftext|>", "it's \"WE'LL\" o'er,'. ...", "ΣΑΣ ÀÉ İi é ́x", "x" * 5000, "1,234.5!! ***THE***", "", "  \n"]
    assert ours(texts) == [truth(t) for t in texts]


def test_documents_equal_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    assert ours(texts) == [truth(t) for t in texts]


def valid(rows, length, texts):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, size in sorted(members):
            assert offset == at
            at += size
        assert at <= length
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = np.array(truth(text or "") + [0], "<u4").tobytes()
        parts = [ids[k : k + 4 * length] for k in range(0, len(ids), 4 * length)]
        got = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, k * length, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]
    assert not by_doc
    return len(bins)


def test_whole_operator(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()}
    texts |= {-1: None, -2: "", -3: "word " * 9000}
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], "doc_id long, text string, length int, row string")
    rows = pack_documents(df).collect()
    used = valid(rows, 2048, texts)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1
    rows = pack_documents(df, length=256, shard=64).collect()
    used = valid(rows, 256, texts)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1


def test_empty_table_and_repeated_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = pack_documents(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_search_saves_bins(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 700 if seed % 2 else 2047) for _ in range(600)]
    plain, packed = packing.best_fit(lengths, 2048), pack(lengths)
    assert sorted(i for b in packed for i in b) == list(range(600))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in packed)
    assert -(-sum(lengths) // 2048) <= len(packed) <= len(plain)


def test_search_mends_a_bad_start():
    lengths = [5, 5, 4, 4, 3, 3]
    assert len(packing.local_search([[0, 4], [1, 5], [2], [3]], lengths, 12)) == 2
