import random

import duckdb

from pairloom.llm import chat, queries


def brute(rows):
    said = {}
    for c, turn, role, text in rows:
        said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in said.items():
        turns.sort()
        for who in sorted({t[2] for t in turns} - {"system"}):
            heads = ["<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f'<|user name="{r}"|>\n' for _, _, r, _ in turns]
            bodies = [t[3] + "<|end|>\n" for t in turns]
            mask = ",".join(f"{len(h)}:0,{len(b)}:{int(t[2] == who)}" for h, b, t in zip(heads, bodies, turns))
            out.append((c, who, len(turns), "".join(h + b for h, b in zip(heads, bodies)), mask))
    return sorted(out, key=str)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, said string")
    parts = {}
    for r in sorted(chat.rotate_perspectives(df, **kw).collect(), key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.perspective), []).append(r)
    return sorted(((c, p, sum(r.n_turns for r in rs), "".join(r.rendered for r in rs), ",".join(r.mask for r in rs)) for (c, p), rs in parts.items()), key=str), parts


def rows():
    rnd = random.Random(2)
    names = ["Ann", "Bob", "é", "user", "assistant", "system"]
    out = []
    for c in range(30):
        cast = rnd.sample(names, rnd.randint(1, 4))
        out += [(c, t, rnd.choice(cast), f"words {rnd.random()} ñ") for t in range(rnd.randint(1, 12))]
    out += [(40, 1, "a", "same")] * 3 + [(41, None, None, None), (41, 1, "b", ""), (None, 1, "c", "x"), (None, 0, "d", "y"), (42, 1, "system", "only")]
    rnd.shuffle(out)
    return out


def test_equals_brute_force(spark):
    assert result(spark, rows())[0] == brute(rows())


def test_large_conversations_come_in_parts(spark):
    rnd = random.Random(8)
    some = rows() + [(7000, rnd.randint(0, 300), rnd.choice("pqr"), f"t{rnd.randint(0, 5)}") for _ in range(900)] + [(7001, 1, "z", "copy")] * 300 + [(7002, 1, "k", "w" * 900), (7002, 2, "l", "v" * 900)]
    got, parts = result(spark, some, most_turns=100, most_chars=1500, stretch=40)
    assert got == brute(some)
    assert all(r.n_turns <= 41 for rs in parts.values() for r in rs)
    assert len(parts[(7000, "p")]) >= 20 and len(parts[(7002, "k")]) >= 2


def test_sql_agrees(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    names = ["conv_id", "part", "perspective", "n_turns", "rendered", "mask"]
    assert sorted(map(tuple, chat.rotate_perspectives(df).select(names).collect())) == sorted(con.sql(chat.SQL).fetchall())


def test_query_equals_sql_on_a_hot_conversation(spark, tmp_path):
    said = [(9, t, "abc"[t * t % 3], f"turn {t}") for t in range(2600)] + [(c, t, "de"[t % 2], f"{c} {t}") for c in range(20) for t in range(4) if c != 9]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    names = ["conv_id", "part", "perspective", "n_turns", "rendered", "mask"]
    got = sorted(map(tuple, queries.QUERIES["op7_perspective_rotation"](spark, str(tmp_path)).select(names).collect()))
    assert got == sorted(con.sql(queries.ORACLE_SQL["op7_perspective_rotation"]).fetchall())
    assert max(r[3] for r in got) == 2600


def test_whole_puts_stretches_together(spark):
    some = rows() + [(7000, t % 250, "pqr"[t % 3], f"t{t % 5}") for t in range(900)] + [(7002, 1, "k", "w" * 900), (7002, 2, "l", "v" * 900)]
    got, parts = result(spark, some, most_turns=100, most_chars=1500, stretch=40, whole=True)
    assert got == brute(some)
    assert all(len(rs) == 1 and rs[0].part == 0 for rs in parts.values())


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.rotate_perspectives(df)
    assert out.collect() == []
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
