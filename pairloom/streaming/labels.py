"""Labelling as a stream: pairs arrive as files, answers go to a cache, no pair is asked twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pairloom.operators.labels import Answer, ask, cache_rows, to_label

PAIRS = "pair_id STRING, split STRING, input_text STRING, dataset STRING, gold_label STRING"


def label_stream(
    spark: SparkSession, pairs_path: str, cache_path: str, labeller: Callable[[str], Answer], mode: str, prompt_version: str, teacher_model: str, checkpoint: str
) -> DataStreamWriter:
    """A writer that asks for what a batch has and the cache has not, and appends the answers.

    Each batch is written once under its own number, so a batch that is tried again
    overwrites what the first try left.
    """
    pairs = spark.readStream.schema(PAIRS).json(pairs_path)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        fresh = rows.dropDuplicates(["pair_id"])
        try:
            known = session.read.parquet(cache_path).filter(f"batch <> {number}").filter("valid").select("pair_id")
            fresh = to_label(fresh, known)
        except Exception as problem:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(problem):
                raise
        out = cache_rows(fresh, ask(fresh, labeller), mode, prompt_version, teacher_model)
        out.write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def usage_by_window(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, tokens and cost per model and window of event time; later rows than ``late`` are dropped."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "teacher_model")
        .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("estimated_cost_usd").alias("cost_usd"))
        .select(F.col("window.start").alias("window_start"), "teacher_model", "calls", "input_tokens", "output_tokens", "cost_usd")
    )
