"""Raw wide rows to typed and serialized pairs; statistics of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import ATTRIBUTES, clean, input_of_lines, input_text

DATASET = "wdc_products"


def record(side: str, source: str) -> Column:
    """The record of one side ("left" or "right") of a wide row."""
    entries = [x for name in ATTRIBUTES for x in (F.lit(name), clean(F.col(f"{name}_{side}")))]
    return F.struct(
        F.col(f"id_{side}").cast("string").alias("record_id"),
        clean(F.col(f"cluster_id_{side}")).alias("entity_id"),
        F.lit(source).alias("source"),
        F.create_map(*entries).alias("attributes"),
    )


def typed_pairs(raw: DataFrame, dataset: str = DATASET) -> DataFrame:
    """pair_id (by default left#right), label, record_a, record_b, metadata; further columns stay."""
    wide = {f"{n}_{s}" for n in (*ATTRIBUTES, "id", "cluster_id") for s in ("left", "right")}
    others = [c for c in raw.columns if c not in wide and c != "pair_id"]
    own = {"pair_id": clean(F.col("pair_id")), "record_a": record("left", dataset), "record_b": record("right", dataset)}
    return paired(raw.select(*[v.alias(k) for k, v in own.items()], *others), dataset)


def paired(met: DataFrame, dataset: str = DATASET) -> DataFrame:
    """``typed_pairs`` of records: rows with pair_id (or null), label, is_hard_negative, record_a and record_b, which may be made once for many pairs."""
    a, b = F.col("record_a"), F.col("record_b")
    meta = F.struct(
        F.lit(dataset).alias("dataset"),
        F.coalesce("is_hard_negative", F.lit(False)).alias("is_hard_negative"),
        a["entity_id"].alias("cluster_id_left"),
        b["entity_id"].alias("cluster_id_right"),
    )
    others = [c for c in met.columns if c not in ("pair_id", "label", "is_hard_negative", "record_a", "record_b")]
    own = F.concat_ws("#", a["record_id"], b["record_id"])
    return met.select(F.coalesce("pair_id", own).alias("pair_id"), (F.col("label") != 0).alias("label"), "record_a", "record_b", meta.alias("metadata"), *others)


def training_rows(pairs: DataFrame) -> DataFrame:
    """Typed pairs with label as 0 or 1, target_label and input_text (of ``lines_a`` and ``lines_b`` where they were made with the records)."""
    made = "lines_a" in pairs.columns
    return pairs.withColumns(
        {
            "target_label": F.when(F.col("label"), "match").otherwise("non-match"),
            "input_text": input_of_lines(F.col("lines_a"), F.col("lines_b")) if made else input_text(F.col("record_a"), F.col("record_b")),
            "label": F.col("label").cast("int"),
        }
    ).drop("lines_a", "lines_b")


def split_statistics(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(F.count("*").alias("pairs"), F.count_if("label").alias("matches"), F.count_if(~F.col("label")).alias("non_matches"))
