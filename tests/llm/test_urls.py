import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.llm import urls

HARD = [None, "", "no scheme", "://", "http://", "http://A.COM", "HTTP://Ex.COM/a?b#c", "http://x.net/es/", "http://net/fr/x", "http://notnet/es/", "http://example.com/en/1", "http://www.example.com/en/1",
        "http://a.www.example.com/en/", "http://com", "http://com/", "x://y://z/q", "http://h?a=/b", "http://h#/p", "http://É.com/é", "http://user:p@a.net:80/es/", "http://a.net/ES/", "http://a\nb.com/c\nd?e"]


def brute(url, rules=urls.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_rules_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    rows = [(i, u, "x") for i, u in enumerate([*HARD, *(p.url for p in pages)])]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, label string")).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
        assert (got[i].score is None) == (rule is not None)


def test_trees_learn_what_rules_say(spark):
    rows = [(i, f"http://h{i % 7}.{'good' if i % 2 else 'bad'}/{'x' * (i % 5)}/{i}") for i in range(400)]
    rules = [("block", f"h{k}.bad", "/") for k in range(5)] + [("allow", f"h{k}.good", "/") for k in range(5)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).filter("rule IS NULL").collect()
    assert len(got) > 80 and all((r.verdict == "block") == r.host.endswith("bad") for r in got)


def test_entropy(spark):
    for text in ["a", "aab", "http://é.x/11"]:
        n, want = len(text), 0.0
        for k in Counter(text).values():
            want -= k / n * math.log2(k / n)
        df = spark.createDataFrame([(text,)], "t string").select(urls._entropy(F.col("t")))
        assert df.first()[0] == pytest.approx(want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.com/"), (1, "http://b.org/"), (None, "http://b.org/")]])
def test_one_verdict_or_none(spark, rows):
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and all(r.verdict == "allow" for r in got)
