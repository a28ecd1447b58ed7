"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Documents are counted by their number of tokens. Over the histogram, sums from
either end answer for each limit L: how many documents fit, how many tokens they
have, and how many tokens remain if every document is cut to L. No sampling and no
bins: a row for each length that occurs.

The sums are taken in two levels (blocks of 1,024 lengths, then within a block), so
no task gets the whole histogram.

Defined cases: a null text is an empty one, of length 0. Each row counts, repeated
doc_ids too. Other columns are ignored, whatever their names. An empty table has an
empty histogram: totals and quantiles of it are empty as well.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm._memo import WordMemo, of_stage

BLOCK = 1024
#: Bytes of words that a worker remembers in a generation.
MEMO_BYTES = 64 << 20


class TokenCounter:
    """Numbers of tokens, by the tiktoken library, with a memory for words."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = WordMemo(lambda words: [len(self.encoding.encode_ordinary(w)) for w in words], MEMO_BYTES)

    def count(self, texts: list[str]) -> list[int]:
        """The pattern always parts a text before a single space with a word after it."""
        plain = [self._parts(t) if t and "  " not in t and t[0] != " " and t[-1] != " " else [] for t in texts]
        return [sum(v) if p else len(self.encoding.encode_ordinary(t)) for p, v, t in zip(plain, self.words.values(plain), texts)]

    @staticmethod
    def _parts(text: str) -> list[str]:
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _rows(path: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_stage(("counts", path), lambda: TokenCounter(path))
        for batch in batches:
            counts, texts, size = [], [], 0
            for text in batch.column(0):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 2 << 20:
                    counts += counter.count(texts)
                    texts, size = [], 0
            counts += counter.count(texts)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return rows


def length_histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs), a row for each length that occurs."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_rows(vocabulary or default_vocabulary()), "n_tokens long")
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def cumulated(histogram: DataFrame) -> DataFrame:
    """The histogram with sums from both ends.

    docs_up_to, tokens_up_to: documents of at most this length and their tokens;
    docs_from: documents of at least this length; truncated_total: tokens of all
    documents cut to this length; total_docs, total_tokens: of all.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    per = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    below, all_ = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "block",
        F.coalesce(F.sum("d").over(below), F.lit(0)).alias("docs_below"),
        F.coalesce(F.sum("t").over(below), F.lit(0)).alias("tokens_below"),
        F.sum("d").over(all_).alias("total_docs"),
        F.sum("t").over(all_).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(per, "block").withColumns(
        {"docs_up_to": F.col("docs_below") + F.sum("n_docs").over(within), "tokens_up_to": F.col("tokens_below") + F.sum("tokens").over(within)}
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        (F.col("total_docs") - F.col("docs_up_to") + F.col("n_docs")).alias("docs_from"),
        (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("total_docs") - F.col("docs_up_to"))).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_truncated, truncated_total) for any limits."""
    pieces = F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("l")) for x in limits])).alias("x")
    return (
        histogram.select("n_tokens", "n_docs", pieces)
        .groupBy(F.col("x.l").alias("context_limit"))
        .agg(
            F.sum(F.when(F.col("n_tokens") > F.col("x.l"), F.col("n_docs")).otherwise(0)).alias("n_truncated"),
            F.sum(F.least("n_tokens", "x.l") * F.col("n_docs")).alias("truncated_total"),
        )
    )


def quantiles(cumulated_histogram: DataFrame, parts: list[float]) -> DataFrame:
    """(part, n_tokens): the smallest length that at least this part of all documents has at most."""
    pieces = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("part")) for p in parts])).alias("x")
    fits = cumulated_histogram.select("n_tokens", "docs_up_to", "total_docs", pieces).filter(F.col("docs_up_to") >= F.col("x.part") * F.col("total_docs"))
    return fits.groupBy("x.part").agg(F.min("n_tokens").alias("n_tokens"))
