"""Scalar functions and features against hand-made values and plain Python."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import numbers, text
from pairloom.functions.features import BUCKETS, FEATURES, with_bucket_scores, with_features
from pairloom.operators.pairs import training_rows, typed_pairs
from pairloom.schemas import RAW_PAIR


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def test_clean(spark):
    assert column(spark, [" a ", "NaN", "none", " null ", "", "\t ", None, "nano"], text.clean) == ["a", None, None, None, None, None, None, "nano"]


def test_model_tokens(spark):
    values = ["Intel Core i3-7100 LGA", "no digits here", "a1 ab1 abc", "first 99x\nplain words", "ÄB-12 x.y_1", "١٢٣ abc"]
    want = [sorted({t.lower() for t in re.findall(r"(?=.*\d)[a-z0-9][a-z0-9._-]{2,}", v, re.I)}) for v in values]
    assert [sorted(x) for x in column(spark, values, text.model_tokens)] == want
    assert want[0] == ["core", "i3-7100", "intel"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("aB1. -\n_é", max_size=14), min_size=10, max_size=40))
def test_tokens_of_random_texts(spark, values):
    got = column(spark, values, lambda v: F.struct(text.word_tokens(v), text.model_tokens(v)))
    for v, (words, models) in zip(values, got):
        assert set(words) == set(re.findall("[a-z0-9]+", v.lower()))
        assert set(models) == {t.lower() for t in re.findall(r"(?=.*\d)[a-z0-9][a-z0-9._-]{2,}", v, re.I)}


def test_price(spark):
    values = ["$1,234", "1.234,56", "12,50 EUR", "1,234.99", "", None, "n.a.", "-5", "5-", "1.2.3", "9" * 400, "7."]
    assert column(spark, values, text.price) == [1.234, 1.23456, 12.5, 1234.99, None, None, None, -5.0, None, None, None, 7.0]


def test_answers(spark):
    values = ["match", " Match\n", '"non_match"', "'Non-Match'", "` match `", "match.", "The answer is match", '"match', '""', '"', None, "", "'\"match\"'"]
    assert column(spark, values, text.answer_label) == ["match", "match", "non_match", "non_match", "match", None, None, None, None, None, None, None, None]


def test_decisions(spark):
    values = ["match", "Non-match: no", "no match", "x [[decision]] match y", '{"decision": "match"}', '{"decision": "{\\"decision\\": \\"non-match\\"}"}', "", "maybe", "why\nmatch", "so 'decision': 'non-match'", '{"decision": null}', "matching"]
    assert column(spark, values, text.decision) == [True, False, False, True, True, False, None, None, None, False, None, True]


def test_labels(spark):
    assert column(spark, ["1", "TRUE", " match", "0", "false", "non_match", "no match"], text.canonical_label) == ["match"] * 3 + ["non_match"] * 4
    with pytest.raises(Exception, match="Unsupported label value"):
        column(spark, ["perhaps"], text.canonical_label)
    assert column(spark, [1, 0], lambda c: text.gold_label(F.lit(None).cast("string"), c), "int") == ["match", "non_match"]
    assert column(spark, ["non_match", "match", "odd"], lambda c: text.class_id(c, {"non-match": 0, "match": 1})) == [0, 1, None]


def test_small_ones(spark):
    assert column(spark, ["openai/gpt-5.4 Mini!", "--A--"], text.slug) == ["openai-gpt-5-4-mini", "a"]
    assert column(spark, ["x/train_128.jsonl", "train_full.x", "other"], text.budget_of) == ["128", "full", None]
    assert column(spark, ["a" * 1201, "b"], text.preview) == ["a" * 1197 + "...", "b"]
    assert column(spark, ['"hi"', '[{"type":"text","text":"a"},{"text":"b"}]', "null"], text.message_text) == ["hi", "ab", ""]
    assert column(spark, ['{"b": 3}', '{"a": 1, "b": 2}', "{}"], lambda c: text.first_key(c, ["a", "b"])) == ["3", "1", None]
    assert column(spark, ["no mark"], lambda c: text.split_input(c)[0]) == [None]
    df = spark.range(1).select(
        numbers.call_cost(F.lit(1000), F.lit(10), F.lit(0.75), F.lit(4.5), F.lit(None).cast("double")).alias("a"),
        numbers.call_cost(F.lit(1000), F.lit(10), F.lit(None).cast("double"), F.lit(4.5), F.lit(None).cast("double")).alias("b"),
        numbers.call_cost(F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.0), F.lit(9.0)).alias("c"),
        numbers.match_probability(F.lit(1000.0), F.lit(1001.0)).alias("d"),
        numbers.rows_per_second(F.lit(5), F.lit(0.0)).alias("e"),
        numbers.is_amount(F.lit(float("nan"))).alias("f"),
    )
    r = df.first()
    assert (r.a, r.b, r.c, r.e, r.f) == (pytest.approx(0.000795), 0.0, 9.0, None, False) and r.d == pytest.approx(1 / (1 + math.exp(-1)))


def raw(spark, *rows):
    names = [c.split()[0] for c in RAW_PAIR.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_PAIR)


ROW = {
    "id_left": 10, "id_right": 11, "title_left": "Acme Camera X100", "title_right": "Acme Camera X200", "brand_left": "Acme", "brand_right": " acme ", "description_left": "Compact digital camera",
    "description_right": None, "price_left": "99.00", "price_right": "100.00", "priceCurrency_left": "USD", "priceCurrency_right": "EUR", "cluster_id_left": 1, "cluster_id_right": 2, "label": 0, "is_hard_negative": True,
}


def test_features_by_hand(spark):
    r = with_bucket_scores(with_features(typed_pairs(raw(spark, ROW)))).first().asDict()
    r |= with_features(typed_pairs(raw(spark, ROW))).first().asDict()
    gap = abs(math.log((99 + 1e-9) / (100 + 1e-9))) / 5
    # Titles share 2 of 4 words, and of the model tokens (acme, camera, x100 and x200) 2 of 4.
    want = {
        "title_similarity": 0.5, "description_similarity": 0.0, "model_overlap": 0.5, "brand_agreement": 1.0, "brand_conflict": 0.0, "model_conflict": 0.0, "currency_conflict": 1.0,
        "price_ratio_gap": round(gap, 6), "missing_key_fields": 1, "hard_negative_hint": 1.0, "surface_similarity": 0.35, "positive_evidence": 0.475, "conflict_evidence": round(0.2 * gap + 0.15, 6),
        "active_hybrid_score": round(0.35 + 0.15 * 0.5 + 0.1 + 0.05 + 0.05 * gap + 0.03 / 4 + 0.02, 6),
    }
    assert {k: r[k] for k in FEATURES} == pytest.approx(want, abs=1e-9)
    c = want["conflict_evidence"]
    scores = (0.45 * 0.35 + 0.1 + 0.2 + 0.1 * (1 - c) + 0.05 * 0.75, 0.35 * 0.475 + 0.25 * 0.7 + 0.2 * 0.65 + 0.025 + 0.1 * (1 - c), 0.45 * 0.65 + 0.1 + 0.05 + 0.05 * want["price_ratio_gap"], 0.35 * 0.35 + 0.095 + 0.2 * c + 0.07)
    assert [r[f"score_{b}"] for b in BUCKETS] == pytest.approx(scores, abs=1.01e-6)


def test_prices_of_other_signs_have_no_gap(spark):
    rows = [ROW | {"price_left": a, "price_right": b} for a, b in (("-5", "5"), ("0", "5"), ("", "5"), ("-5", "-6"), ("1", "1000000"))]
    assert [r.price_ratio_gap for r in with_features(typed_pairs(raw(spark, *rows))).select("price_ratio_gap").collect()] == [0, 0, 0, 0, 1.0]


def test_pairs_and_serialization(spark):
    r = training_rows(typed_pairs(raw(spark, ROW))).first()
    assert (r.pair_id, r.label, r.target_label, r.record_a.entity_id, r.metadata.is_hard_negative) == ("10#11", 0, "non-match", "1", True)
    assert r.input_text.split("\n") == [
        "Task: decide whether Record A and Record B refer to the same real-world entity.", "", "Record A:", "- title: Acme Camera X100", "- brand: Acme", "- description: Compact digital camera", "- price: 99.00", "- priceCurrency: USD", "",
        "Record B:", "- title: Acme Camera X200", "- brand: acme", "- description: <missing>", "- price: 100.00", "- priceCurrency: EUR",
    ]
    more = spark.sql("SELECT struct(map('z', '1', 'title', 'T', 'a', CAST(NULL AS STRING)) AS attributes) AS r").select(text.record_lines(F.col("r"), "A").alias("t")).first().t
    assert more.split("\n")[-2:] == ["- a: <missing>", "- z: 1"]
