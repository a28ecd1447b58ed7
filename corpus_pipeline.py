"""Corpus pipeline: toxicity, quality, line dedup, near dedup, packing.

Each stage is a function of (spark, docs, sf_dir), where docs has the columns of
the table ``documents``. Its result is written as Parquet and read again as the next
one's docs. All but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm._common import col, discard, join_small, made_so_far, own, prefix, table, written
from pairloom.llm.line_dedup import line_dedup
from pairloom.llm.near_dedup import near_duplicates
from pairloom.llm.packing import pack_documents
from pairloom.llm.quality import quality_filter
from pairloom.llm.toxicity import toxicity_filter

#: Most row numbers (8 bytes each) that are broadcast.
MOST_GONE = 1_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier takes for toxic go."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fences of their language and source go."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; n_chars follows."""
    cut = line_dedup(docs)
    length = F.length("text")
    return cut.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles one row stays: the smallest doc_id, of equal ones the first row.

    Rows without doc_id come after all others. Documents are told apart by the number
    of their row in a written table, so null and repeated ids are no exception.
    """
    p = prefix(docs.columns)
    row, order = p + "row", p + "order"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("c"))
    ids = numbered.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias(order))
    members = written(found.join(ids, row).select("c", row, order), "members")
    stay = members.groupBy("c").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = written(members.select(row).join(stay, row, "left_anti"), "gone")
    # Numbers alone: while they are few, the texts stay where they are.
    return own(join_small(numbered, gone, [row], "left_anti", MOST_GONE), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), made_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        # The stage's own tables, and what it has read, are no longer needed.
        discard(begun)
    return STAGES[-1][1](spark, docs, sf_dir)
