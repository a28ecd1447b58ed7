import hashlib
import random

import numpy as np
import pytest

from pairloom.llm.exact_dedup import MAX_CHUNK, MIN_CHUNK, chunk_ends, cut_points, exact_dedup

SCHEMA = "doc_id long, text string, recipe string, h string"


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = [f"wörd{k}" for k in range(500)]
    texts = [" ".join(rnd.choices(words, k=n)) for n in (5, 100, 3000, 20000)]
    edited = [t[:-1] + "!" for t in texts]
    return list(enumerate([*texts, *edited, *texts, "", None, "", texts[2], "x" * 200_000, "x" * 200_000]))


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    return sorted(map(tuple, exact_dedup(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_equals_brute_force(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_colliding_identifiers_are_told_apart(spark, rows):
    assert result(spark, rows, hash_bits=2) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_repeated_rows_and_null_ids(spark):
    got = result(spark, [(7, "a"), (7, "a"), (3, "a")])
    assert [r[:3] for r in got] == [(3, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert sum(r[3] for r in got) == 1
    df = spark.createDataFrame([(None, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.text_sha256[:4], r.keep_id, r.kept) for r in exact_dedup(df).collect() if r.doc_id is None) == sorted(
        [(hashlib.sha256(b"a").hexdigest()[:4], 2, False), (hashlib.sha256(b"b").hexdigest()[:4], None, True)], key=lambda r: r[0]
    )


def test_cuts_resist_shifts():
    data = np.frombuffer(random.Random(1).randbytes(300_000), np.uint8)
    cut = lambda d: {bytes(d[a:b]) for a, b in zip([0, *chunk_ends(cut_points(d), 0, len(d))], chunk_ends(cut_points(d), 0, len(d)))}
    before, after = cut(data), cut(np.concatenate([data[:100], data[50:60], data[100:]]))
    assert len(before & after) >= len(before) - 3
    assert all(len(c) <= MAX_CHUNK for c in before)
    assert sum(len(c) < MIN_CHUNK for c in before) <= 1
