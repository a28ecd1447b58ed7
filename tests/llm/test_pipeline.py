"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm.packing import WordEncoder, default_vocabulary
from pairloom.llm.quality import quality
from pairloom.llm.toxicity import toxicity
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_toxic_and_poor_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity(steps[0], labels).collect() if r.predicted}
    assert rows(steps[1]) == [r for r in rows(steps[0]) if r[0] not in bad] and bad
    good = {r.doc_id for r in quality(steps[1]).collect() if r.kept}
    assert rows(steps[2]) == [r for r in rows(steps[1]) if r[0] in good]


def test_lines_and_copies_go(steps):
    assert rows(steps[3]) == [r[:2] for r in brute_lines(rows(steps[2]))]
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    stay = {r[0] for r in brute_near(rows(steps[3]), 5) if r[3]}
    assert rows(steps[4]) == [r for r in rows(steps[3]) if r[0] in stay]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    said = [(None, a), (None, a + " end"), (7, b), (7, b), (7, b + " end"), (None, b), (3, c), (None, c), (None, "alone"), (None, None), (None, None), (9, "other words"), (9, "of one id")]
    docs = spark.createDataFrame(said, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_stage(spark, docs, SF).collect()
    groups = sorted((t[:1], i) for i, t in kept if t and len(t) > 20)
    assert groups == [("a", None), ("b", 7), ("c", 3)]
    assert sorted(map(str, ((i, t) for i, t in kept if not t or len(t) <= 20))) == sorted(map(str, said[8:]))


def test_packed(spark, steps):
    encode = WordEncoder(default_vocabulary()).tokenizer.encode
    got = {}
    for r in steps[5].collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in rows(steps[4]):
        ids = np.array(encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes()
        cut = [ids[k : k + 8192] for k in range(0, len(ids), 8192)]
        assert sorted(got.pop(i)) == [(k, 2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(cut)]
    assert not got
    assert sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.piece) for r in steps[5].collect())


@pytest.mark.parametrize("names", [["n_lines", "__score", "__n_words", "kept"], ["N_LINES", "__SCORE", "__row", "Row"], ["__", "___n_words", "n_removed_lines", "a.b"]])
def test_clashing_columns_pass_through(spark, names):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [stage(spark, docs, SF) for _, stage in corpus_pipeline.STAGES[1:4]]
    for name in names:
        docs = docs.withColumn(name, docs.doc_id * 2)
    for (_, stage), want in zip(corpus_pipeline.STAGES[1:4], plain):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert rows(got) == rows(want)
        assert all(r[-1] == 2 * r.doc_id for r in got.collect())
    kept = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def test_rows_that_share_an_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text), (5, text), (5, "something else entirely")], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == [(3, text), (5, "something else entirely")]
