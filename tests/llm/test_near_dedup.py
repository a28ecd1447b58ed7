import random
import re

import numpy as np
import pytest

from pairloom.llm import near_dedup
from pairloom.llm._groups import components
from pairloom.llm.near_dedup import near_duplicates


def shingles(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def result(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, k string, root int")
    return sorted(map(tuple, near_duplicates(df, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def family(rnd, words, size, length, edits):
    base = rnd.choices(words, k=length)
    for _ in range(size):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        yield " ".join(t)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["É", "the x", "A"]
    texts = [None, "", " \n", "one", "One", "one two", "ONE two", "é", "É", *family(rnd, words, 90, 120, 9), *family(rnd, words, 30, 40, 3), *family(rnd, words, 12, 9, 1)]
    for _ in range(40):
        texts += family(rnd, words, rnd.randint(1, 4), rnd.randint(1, 200), 6)
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("kw", [{"width": 2}, {"width": 5}, {"width": 2, "leaf": 4, "depth": 3}, {"width": 2, "leaf": 4, "block_classes": 16}])
def test_equals_brute_force(spark, rows, kw):
    assert result(spark, rows, **kw) == brute(rows, kw["width"])


def test_sample_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(spark, rows, width=2) == brute(rows, 2)


def test_empty_and_repeated_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [(4, "a b"), (4, "a b"), (9, "q r"), (4, "q r")]) == [(4, 1, 4, True)] * 3 + [(9, 1, 4, False)]
    got = result(spark, [(None, "a b"), (3, "a b"), (3, None)])
    assert sorted(got, key=str) == sorted([(None, 1, 3, False), (3, 1, 3, True), (3, 0, 3, True)], key=str)


def test_low_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        result(spark, [], percent=50)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 900 / 1100) < 0.12


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(100)]
    up = {v: v for e in edges for v in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == {v: root(v) for v in linked}
