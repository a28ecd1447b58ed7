"""URL filter: rules first, and for the rest gradient-boosted trees on lexical features.

A rule names a host and the start of a path. It fits that host and its subdomains;
of several that fit, the longest wins. The URLs that rules decide are the labelled
ones: a bounded sample of them (the ``TRAIN_ROWS`` smallest by a hash of the URL)
trains the trees, and these judge the URLs that no rule fits. Features are lengths,
depth, digit ratio, character entropy, counts of parameters and labels, and suffix
statistics: the smoothed share of blocked URLs among sample URLs whose host ends
alike, and whose path starts alike, in 256 hashed classes.

Defined cases: a null url, or one without "://", has an empty host and path, so no
rule fits. If the sample has one verdict only, the rest gets it; if it is empty,
the rest is allowed. Rows that repeat a page_id are rows of their own. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import written

#: Verdict, host, path prefix.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
TRAIN_ROWS = 20_000
TREES, DEPTH, SUFFIX_CLASSES = 20, 4, 256
FEATURES = ["n_chars", "host_chars", "path_chars", "depth", "labels", "digits", "entropy", "params", "marks", "suffix_rate", "segment_rate"]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character, over the characters of the whole text."""
    n = F.length(text).cast("double")

    def part(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c))) / n
        return -share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(part(c)))).otherwise(0.0)


def _classes(host: Column, path: Column) -> tuple[Column, Column]:
    class_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SUFFIX_CLASSES)).cast("int")
    return class_of(F.substring_index(host, ".", -1)), class_of(F.regexp_extract(path, "^/([^/]*)/", 1))


def with_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the features but for the two rates, and the classes of those."""
    url = F.coalesce(F.col("url"), F.lit(""))
    suffix, segment = _classes(F.col("host"), F.col("path"))
    return urls.withColumns(
        {
            "n_chars": F.length(url).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "depth": _count(F.col("path"), "/"),
            "labels": _count(F.col("host"), "."),
            "digits": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
            "entropy": _entropy(url),
            "params": _count(url, "&="),
            "marks": _count(url, "#-_%."),
            "suffix_class": suffix,
            "segment_class": segment,
        }
    )


def _with_rates(featured: DataFrame, rates: dict[str, list[float]]) -> DataFrame:
    look = lambda name: F.element_at(F.array(*[F.lit(x) for x in rates[name]]), F.col(f"{name}_class") + 1)
    return featured.withColumns({"suffix_rate": look("suffix"), "segment_rate": look("segment")})


def suffix_rates(sample: DataFrame) -> dict[str, list[float]]:
    """Share of blocked URLs in each class, drawn towards the share of all; 256 numbers each."""
    total, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = blocked / total
    out = {}
    for name in ("suffix", "segment"):
        found = {r[0]: (r.n, r.b) for r in sample.groupBy(f"{name}_class").agg(F.count("*").alias("n"), F.sum("label").alias("b")).collect()}
        out[name] = [(found.get(k, (0, 0))[1] + 5 * base) / (found.get(k, (0, 0))[0] + 5) for k in range(SUFFIX_CLASSES)]
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (of the trees: null where a rule decides)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    urls = urls.withColumns({"rule": rule, "ruled": verdict})

    labelled = urls.filter("rule IS NOT NULL").select("url", "host", "path", "ruled")
    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(train_rows).withColumn("label", (F.col("ruled") == "block").cast("double"))
    sample = written(with_features(sample).drop("ruled"), "sample")
    seen = {r.label for r in sample.select("label").distinct().collect()}
    featured = with_features(urls)
    if len(seen) < 2:
        scored = featured.withColumn("score", F.lit(max(seen, default=0.0)))
    else:
        rates = suffix_rates(sample)
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11).fit(vector.transform(_with_rates(sample, rates)).select("label", "features"))
        scored = model.transform(vector.transform(_with_rates(featured, rates))).withColumn("score", vector_to_array("probability")[1])
    free = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", free).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
