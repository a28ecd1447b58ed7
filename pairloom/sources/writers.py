"""Writers: JSON lines, CSV and single documents. Spark's commit makes them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, limit: int | None = None, order: str | None = None) -> int:
    """Overwrite JSON lines, nulls written out; the number of rows in the files."""
    some = rows if limit is None else (rows.orderBy(order) if order else rows).limit(limit)
    some.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A small result table as one CSV file with a header, columns and rows in a fixed order."""
    rows.select(columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_table(rows: DataFrame, path: str) -> None:
    """Further rows of a table: each append is a file of its own with the same header."""
    rows.write.mode("append").option("header", True).csv(path)


def write_document(row: DataFrame, path: str) -> None:
    """One row as a JSON document."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_key_values(entries: DataFrame, path: str) -> None:
    """(key, value) rows as sorted key=value lines."""
    entries.orderBy("key").select(F.concat_ws("=", "key", F.coalesce("value", F.lit(""))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
