import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm.line_dedup import chunks, line_dedup

SCHEMA = "doc_id long, text string, parts string, h string"


def cut(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    long = [x.count(" ") >= 49 for x in lines]
    out, now = [], []
    for i, x in enumerate(lines):
        now.append(x)
        if i == len(lines) - 1 or long[i] or long[i + 1] or (h[i] + (31 * h[i - 1] if i else 0)) % 3 == 0:
            out.append((now, len(now) > 1 or long[i]))
            now = []
    return out


def brute(rows):
    keeper = {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, (c, passage) in enumerate(cut(t)):
            if passage:
                keeper.setdefault("\n".join(c), (d, k))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept = [c for k, (c, passage) in enumerate(cut(t)) if not passage or keeper["\n".join(c)] == (d, k)]
        n = len(t.split("\n"))
        out.append((d, "\n".join("\n".join(c) for c in kept), n, n - sum(map(len, kept))))
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "parts", "h", "n_lines", "n_removed_lines"]
    return sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed_lines").collect()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.randint(0, 999)}é" for _ in range(rnd.choice([1, 5, 20, 80])))
    passages = [[line() for _ in range(rnd.randint(1, 9))] for _ in range(8)]
    texts = ["", "\n", "\n\n\n", None, None, "one line", "one line"]
    for _ in range(60):
        parts = [[line() for _ in range(rnd.randint(0, 4))] if rnd.random() < 0.5 else rnd.choice(passages) for _ in range(rnd.randint(1, 6))]
        texts.append("\n".join(x for p in parts for x in p))
    texts += texts[10:14] + ["\n".join(passages[0] * 5)] + ["\n".join(line() for _ in range(5000))] * 2
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark, rows):
    got, want = result(spark, rows), brute(rows)
    assert got == want
    assert sum(r[3] for r in want) > 4000


def test_chunks_join_to_the_text(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "doc_id long, text string")
    for r in df.withColumn("c", chunks(F.col("text"))).collect():
        assert [c.body for c in r.c] == ["\n".join(c) for c, _ in cut(r.text)]
        assert "\n".join(c.body for c in r.c) == r.text


def test_shifts_move_few_chunks():
    rnd = random.Random(4)
    lines = [f"line {rnd.random()}" for _ in range(400)]
    before = {tuple(c) for c, _ in cut("\n".join(lines))}
    after = {tuple(c) for c, _ in cut("\n".join(lines[:50] + ["new"] + lines[50:]))}
    assert len(before - after) <= 3


def test_empty_table_and_odd_ids(spark):
    assert result(spark, []) == []
    text = "\n".join("abcdefghij")
    got = result(spark, [(1, text), (1, text), (2, text)])
    assert [r[1] for r in got[:2]] == [text, text] and got[2][3] > 0
    nulls = spark.createDataFrame([(None, text), (5, text), (None, None)], "doc_id long, text string")
    kept = {(r.doc_id, r.text is None): r.n_removed_lines for r in line_dedup(nulls).collect()}
    assert kept[(5, False)] == 0 and kept[(None, False)] > 0 and kept[(None, True)] == 0


def test_plan_has_no_python(spark, rows):
    df = line_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
