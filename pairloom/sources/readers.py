"""Readers: JSON lines plain, gzipped and zipped, documents, and dataset folders."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.pairs import typed_pairs
from pairloom.schemas import RAW_PAIR, cache_violations

#: Fixed value: how the files of a split are named.
SPLIT_FILE = re.compile(r"wdcproducts(?P<corner>\d+)cc(?P<rest>\d+)rnd(?P<unseen>\d+)un_(?P<kind>train|valid|gs)(?:_(?P<size>\w+))?\.json\.gz$")
SPLITS = {"train": "train", "valid": "validation", "gs": "test"}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (also .gz); blank lines are passed over, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, as ``value``, with ``ordinal``, the place in the order of the files.

    A row's place is its file's place and its offset inside: the number of a row
    within its partition plus the rows of the partitions before it. Only counts of
    partitions go to the driver.
    """
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    starts, total = [], 0
    for p, n in sorted(map(tuple, lines.groupBy("p").count().collect())):
        starts.append((p, total))
        total += n
    # A row a partition of the read.
    placed = lines.join(F.broadcast(spark.createDataFrame(starts, "p int, start long")), "p")
    place = F.col("start") + (F.col("m") - F.shiftleft(F.col("p").cast("long"), 33))
    return placed.filter(F.regexp_replace("value", r"\s", "") != "").select("value", place.alias("ordinal"))


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``ordinal``, the place in the order of the files; a bad line is an error."""
    read = _numbered_lines(spark, path).select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return read.select("row.*", "ordinal")


def first_json_lines(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """The rows among the first ``limit`` lines of the files, where blank lines count."""
    return numbered_json_lines(spark, path, schema).filter(F.col("ordinal") < limit).drop("ordinal")


def target_rows(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """Training targets, of one split if it is named."""
    rows = json_lines(spark, path, schema)
    return rows if split is None else rows.filter(F.col("split") == split)


def decision_threshold(spark: SparkSession, path: str) -> float:
    """The threshold that a document names; 0.5 where there is no document, an error outside 0 to 1."""
    try:
        told = document(spark, path, "decision_threshold DOUBLE").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0.5
    if told is None or told[0] is None or not 0.0 <= told[0] <= 1.0:
        raise ValueError(f"{path} names no threshold between 0 and 1: {told and told[0]}")
    return told[0]


def checked_cache(spark: SparkSession, path: str, schema: str, direct: bool = False) -> DataFrame:
    """Cache lines with ``ordinal``, from 0 with blank lines counted, and ``violations``; a line that is no JSON has "unparsable" and stays as ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = _numbered_lines(spark, path).select("ordinal", F.from_json("value", f"{schema}, _corrupt_record STRING", options).alias("row"))
    rows = read.select("row.*", "ordinal")
    bad = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("unparsable"))).otherwise(cache_violations(direct))
    return rows.withColumn("violations", bad)


def document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one or more files, each over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def zipped_json_lines(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """JSON lines of members of zip archives whose names match ``member``, gzipped or not.

    A task takes an archive: zip has no codec in Spark. Lines are parsed by Spark.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(member)
        for batch in batches:
            for content in batch.content:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not pattern.search(name):
                            continue
                        with archive.open(name) as raw:
                            stream = gzip.open(raw) if name.endswith(".gz") else raw
                            some: list[str] = []
                            for line in stream:
                                some.append(line.decode().strip())
                                if len(some) == 5000:
                                    yield pd.DataFrame({"name": name, "value": some})
                                    some = []
                            if some:
                                yield pd.DataFrame({"name": name, "value": some})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "name string, value string")
    return raw.filter(F.regexp_replace("value", r"\s", "") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def files_under(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files under a folder, or of the members of a zip archive."""
    if root.endswith(".zip"):
        names = spark.read.format("binaryFile").load(root).select("content").mapInPandas(
            lambda it: (pd.DataFrame({"name": zipfile.ZipFile(io.BytesIO(c)).namelist()}) for b in it for c in b.content), "name string"
        )
        return sorted(r.name for r in names.collect())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return sorted(r.path for r in files.collect())


def split_files(names: list[str], corner: int = 80, unseen: int = 0, size: str = "small", test_unseen: int = 100) -> dict[str, str]:
    """The file of each split: train and validation of a size, test by its share of unseen products. The last match wins."""
    out: dict[str, str] = {}
    for name in names:
        m = SPLIT_FILE.search(name)
        if not m or int(m["corner"]) != corner:
            continue
        wanted = int(m["unseen"]) == test_unseen if m["kind"] == "gs" else int(m["unseen"]) == unseen and m["size"] == size
        if wanted:
            out[SPLITS[m["kind"]]] = name
    if missing := sorted(set(SPLITS.values()) - out.keys()):
        raise FileNotFoundError(f"No files for splits: {missing}")
    return out


def load_pairs(spark: SparkSession, root: str, limit_per_split: int | None = None, **config: object) -> DataFrame:
    """Typed pairs of all splits of a dataset folder or archive, with a column ``split``."""
    chosen = split_files(files_under(spark, root), **config)

    def one(split: str, name: str) -> DataFrame:
        if root.endswith(".zip"):
            rows = zipped_json_lines(spark, root, re.escape(name) + "$", RAW_PAIR)
            # A file in an archive is read by one task, in its order.
            rows = rows if limit_per_split is None else rows.limit(limit_per_split)
        elif limit_per_split is None:
            rows = json_lines(spark, name, RAW_PAIR)
        else:
            rows = numbered_json_lines(spark, name, RAW_PAIR).orderBy("ordinal").limit(limit_per_split).drop("ordinal")
        return typed_pairs(rows).withColumn("split", F.lit(split))

    return reduce(DataFrame.unionByName, [one(s, n) for s, n in chosen.items()])


def cost_assumptions(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, currency, usd_per_gpu_hour, assumptions_sha256) of a versioned document, after its checks."""
    schema = "schema_version INT, currency STRING, scenarios ARRAY<STRUCT<name: STRING, usd_per_gpu_hour: DOUBLE>>"
    read = document(spark, path, schema).select("schema_version", "currency", F.explode_outer("scenarios").alias("s"))
    rows = read.select("schema_version", "currency", F.trim("s.name").alias("scenario"), "s.usd_per_gpu_hour").collect()
    if not rows or rows[0].schema_version != 1:
        raise ValueError("Cost assumptions must use schema_version=1")
    names = [r.scenario for r in rows]
    if None in names or "" in names or len(set(names)) < len(names):
        raise ValueError(f"Invalid or duplicate cost scenario names: {names}")
    if any(r.usd_per_gpu_hour is None or not 0 <= r.usd_per_gpu_hour < float("inf") for r in rows):
        raise ValueError("Invalid GPU-hour rate")
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("assumptions_sha256"), F.lit(1).alias("one"))
    table = spark.createDataFrame([(r.scenario, r.currency, r.usd_per_gpu_hour, 1) for r in rows], "scenario string, currency string, usd_per_gpu_hour double, one int")
    return table.join(F.broadcast(digest), "one").drop("one")
