"""The registered queries of the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import chat, line_dedup, quality
from pairloom.llm._common import table, written
from pairloom.llm.exact_dedup import exact_dedup
from pairloom.llm.near_dedup import near_duplicates
from pairloom.llm.packing import pack_documents
from pairloom.llm.pieces import encode_pieces
from pairloom.llm.token_counts import cumulated, length_histogram
from pairloom.llm.toxicity import toxicity
from pairloom.llm.urls import judge_urls


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per encoded length: every context limit's totals and quantiles can be read from it."""
    return cumulated(written(length_histogram(table(spark, sf_dir, "documents")), "histogram"))


def op3_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed_lines", "text")


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_piece_agenda_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), full=False)


def op6_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"), whole=True)


def op8_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_swap_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_string_kernel_toxicity,
        op2_length_histogram,
        op3_line_chunk_dedup,
        op4_adaptive_quality,
        op5_piece_agenda_coding,
        op6_chosen_path_near_dedup,
        op7_perspective_rotation,
        op8_chunk_recipe_dedup,
        op9_boosted_url_filter,
        op10_swap_search_packing,
    )
}

ORACLE_SQL = {
    "op3_line_chunk_dedup": line_dedup.SQL,
    "op4_adaptive_quality": quality.SQL,
    "op7_perspective_rotation": chat.SQL,
    "op8_chunk_recipe_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
