import random
import re

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    seen, dup, lines = set(), 0, text.split("\n")
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(lines)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é#|\n\t\x1c\u00a0 中"), max_size=60), min_size=1, max_size=5))
def test_measures_equal_brute_force(texts):
    got = [a.tolist() for a in q.measures(pa.array(texts, pa.large_string()))]
    assert [list(r) for r in zip(*got)] == [brute(t) for t in texts]


def test_bins():
    for v in [*range(300), 1000, 12345]:
        drop = max(v.bit_length() - 6, 0)
        assert v - v % 2**drop == (v >> drop) << drop


def rows():
    rnd = random.Random(1)
    out = []
    for i in range(900):
        words = [rnd.choice(["the", "über", "con", "le"]) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(1, 80))]
        kind = i % 30
        if kind == 0:
            words = [w + "%%%" for w in words]
        if kind == 1:
            words = ["w" * 300 for _ in words]
        if kind == 2:
            words = words[:6] * 9
        text = " ".join(words) if kind != 3 else "\n".join(words[: len(words) // 2] * 2)
        out.append((i, text if kind != 4 else rnd.choice(["", None, " \n "]), rnd.choice(["en", None, "de"]), rnd.choice(["hot", "hot", "hot", "a", None])))
    return out


def test_equals_sql_and_adapts(spark):
    df = spark.createDataFrame([(*r, 5) for r in rows()], "doc_id long, text string, lang string, source string, __lang int")
    got = sorted(map(tuple, q.quality(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == sorted(con.sql(q.SQL).fetchall())
    verdicts = {r[0]: (r[-2], r[-1]) for r in got}
    texts = {r[0]: r[1] or "" for r in rows()}
    long = [i for i in texts if len(texts[i].split()) >= 10]
    assert not any(verdicts[i][1] for i in long if i % 30 in (0, 1, 2))
    clean = [i for i in long if i % 30 > 4]
    assert all(verdicts[i][1] for i in clean) and len(clean) > 500
    kept = q.quality_filter(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, v in sorted(verdicts.items()) if v[1]]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(1, None, None, None)][:n], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in q.quality(df).collect()] == [(1, 0, 0, 0, 0, 0, True, False)][:n]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s")] * 3, "doc_id long, text string, lang string, source string")
    assert [r.kept for r in q.quality(df).collect()] == [True] * 3
