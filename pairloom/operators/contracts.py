"""Contracts and manifests of artifacts as key and value tables, and their differences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def parse_fields(lines: Iterable[str]) -> dict[str, str]:
    """KEY=VALUE lines; empty or repeated keys are errors."""
    out: dict[str, str] = {}
    for line in lines:
        key, equals, value = line.partition("=")
        if not equals or not key:
            raise ValueError(f"Expected KEY=VALUE, found {line!r}")
        if key in out:
            raise ValueError(f"Duplicate key: {key}")
        out[key] = value
    return out


def parsed_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """KEY=VALUE lines of a table as key, value and error (empty_key, no_value, repeated_key or null)."""
    parts = F.split(F.col(column), "=", 2)
    cut = lines.withColumns({"key": parts[0], "value": F.get(parts, F.lit(1))})
    n = cut.groupBy("key").agg(F.count("*").alias("times"))
    error = F.when(F.col("value").isNull(), "no_value").when(F.col("key") == "", "empty_key").when(F.col("times") > 1, "repeated_key")
    return cut.join(n, "key").select("key", "value", error.alias("error"))


def difference(expected: DataFrame, found: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows (section, key, expected, found) that are not the same; a key may be missing on either side."""
    both = expected.select("section", "key", F.col("value").alias("expected")).join(found.select("section", "key", F.col("value").alias("found")), ["section", "key"], "full_outer")
    wrong = both.filter(~F.col("expected").eqNullSafe(F.col("found")))
    return wrong.filter(~F.col("key").isin(*ignore)) if ignore else wrong


def contract(spark, fields: dict[str, str], files: dict[str, str]) -> DataFrame:
    """A contract as (section, key, value): fields, sha256 of files (by glob-free path), and the version."""
    rows = [("fields", k, v) for k, v in fields.items()] + [("schema_version", "schema_version", str(SCHEMA_VERSION))]
    table = spark.createDataFrame(rows, "section string, key string, value string")
    for name, path in files.items():
        table = table.unionByName(digests(spark, path).select(F.lit("files").alias("section"), F.lit(name).alias("key"), F.col("sha256").alias("value")))
    return table


def digests(spark, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) of a file manifest against the files: path, size_bytes, sha256 on both sides."""
    named = manifest.groupBy("path").agg(F.count("*").alias("times"), F.max("size_bytes").alias("m_size"), F.max("sha256").alias("m_sha"))
    both = named.join(actual.select("path", F.col("size_bytes").alias("a_size"), F.col("sha256").alias("a_sha")), "path", "full_outer")
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | (F.col("path") == "")
    checks = {
        "repeated": F.col("times") > 1,
        "unsafe": F.col("times").isNotNull() & unsafe,
        "missing": F.col("a_sha").isNull(),
        "untracked": F.col("times").isNull(),
        "size": F.col("m_size") != F.col("a_size"),
        "sha256": F.col("m_sha") != F.col("a_sha"),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]))
    return both.select("path", F.explode(found).alias("problem"))


def expect_rows(rows: DataFrame, n: int, what: str) -> DataFrame:
    """``rows``, or an error if their number is not ``n``."""
    if (found := rows.count()) != n:
        raise ValueError(f"{what}: {found} rows instead of {n}")
    return rows
