from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm.token_counts import TokenCounter, cumulated, default_vocabulary, length_histogram, quantiles, truncated_totals

COUNTER = TokenCounter(default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab é.' \n\t\u00a0\u2003中😀1'd"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_equals_the_library(texts):
    assert COUNTER.count(texts) == [len(COUNTER.encoding.encode_ordinary(t)) for t in texts]


def test_histogram_and_sums(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "x", " " * 50, "x " * 20_000]
    lengths = [len(COUNTER.encoding.encode_ordinary(t or "")) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int")
    hist = length_histogram(df)
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    rows = cumulated(hist).collect()
    for r in rows:
        assert r.docs_up_to == sum(x <= r.n_tokens for x in lengths)
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_up_to == sum(x for x in lengths if x <= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for r in truncated_totals(hist, [0, 100, 2048, 10**6]).collect():
        assert (r.n_truncated, r.truncated_total) == (sum(x > r.context_limit for x in lengths), sum(min(x, r.context_limit) for x in lengths))
    found = {r.part: r.n_tokens for r in quantiles(cumulated(hist), [0.5, 0.9, 1.0]).collect()}
    ordered = sorted(lengths)
    assert found == {p: next(x for x in ordered if sum(y <= x for y in ordered) >= p * len(ordered)) for p in (0.5, 0.9, 1.0)}


def test_empty_table(spark):
    hist = length_histogram(spark.createDataFrame([], "text string"))
    assert hist.collect() == [] and cumulated(hist).collect() == [] and truncated_totals(hist, [5]).collect() == []
