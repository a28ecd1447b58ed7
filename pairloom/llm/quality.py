"""Quality rules whose thresholds follow the corpus, by language and source.

Each document has four rates, as whole numbers: symbols per 1,000 word characters,
repeated lines per 1,000 lines, words in repeated windows per 1,000 words, and
characters per 100 words. A sketch counts documents by language, source, rate and
bin. A bin keeps the six leading bits of a rate, so a value read from it is at most
1/32 too small. Sketches merge by adding counts; that of a language is the sum of
those of its sources.

From a sketch come the quartiles, and from them fences: a rate may lie ``SPREAD``
times the distance between the quartiles beyond them, and ``SLACK`` beyond that.
Sources with fewer than ``LEAST`` documents use the fences of their language,
languages with fewer use those of all documents. The fences are joined to the
documents, whose verdict is whether all rates lie within.

Defined cases: a null text has no words, fails the base rules, and counts nowhere.
Null languages and sources are values like others. Rows that repeat a doc_id are
documents of their own. Other columns are kept (``judged``). An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm._common import col, join_small, own, prefix, text_map, written
from pairloom.llm._words import no_blanks, words

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
BITS, LEAST, SPREAD = 6, 200, 6
#: Rate: slack above and (if any) below the fences.
SLACK = {"symbols": (60, None), "dup_lines": (250, None), "repeats": (200, None), "length": (150, 150)}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, how many words lie in a window of five that it has twice or more."""
    ids = ids.astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = len(ids) - WINDOW + 1
    if last <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    starts = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :])
    mixed = doc[starts].astype(np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[starts + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = np.sort(starts[order[twice]])
    if len(some):
        # Equal hashes only name candidates; the words themselves decide.
        windows = np.stack([doc[some], *(ids[some + k] for k in range(WINDOW))], axis=1)
        _, back, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        some = some[count[back.ravel()] > 1]
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, some, 1)
    np.add.at(step, some + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 1, 0
    worded = [x for x in lines if x.split(None, 1)]
    return len(lines), len(worded) - len(set(worded))


def measures(texts: pa.Array) -> list[np.ndarray]:
    _, ids, bounds = no_blanks(words(texts))
    raw = texts.cast(pa.large_binary()).to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in raw])])

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[edges[1:]] - total[edges[:-1]]

    lines = np.array([_dup_lines(t) for t in raw], np.int64).reshape(-1, 2)
    return [
        np.diff(bounds),
        per_text(((data & 0xC0) != 0x80) & ~_IS_BLANK[data]),
        per_text(_IS_SYMBOL[data]),
        lines[:, 1],
        repeated_words(ids, bounds),
        lines[:, 0],
    ]


def with_measures(docs: DataFrame, text_col: str = "text", p: str = "__") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, all named with ``p`` before."""
    return text_map(docs, text_col, lambda: measures, [T.StructField(p + c, T.LongType()) for c in [*BASE, "n_lines"]])


def _rates(p: str) -> dict[str, Column]:
    c = lambda name: F.col(p + name)
    whole: Callable[[Column], Column] = lambda x: F.floor(x).cast("long")
    return {
        "symbols": whole(1000 * c("n_symbols") / F.greatest(c("word_chars"), F.lit(1))),
        "dup_lines": whole(1000 * c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))),
        "repeats": whole(1000 * c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1))),
        "length": whole(100 * c("word_chars") / F.greatest(c("n_words"), F.lit(1))),
    }


def bin_of(rate: Column) -> Column:
    """The smallest rate of the same bin: all but the six leading bits cleared."""
    drop = F.greatest(F.length(F.bin(rate)) - BITS, F.lit(0))
    return rate - rate % F.pow(F.lit(2), drop).cast("long")


def sketches(measured: DataFrame, lang_col: str, source_col: str, p: str = "__") -> DataFrame:
    """(lang, source, rate, bin, n): mergeable by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(v).alias("bin")) for k, v in _rates(p).items()]))
    some = measured.filter(F.col(p + "n_words") > 0).select(col(lang_col).alias("lang"), col(source_col).alias("source"), each.alias("x"))
    return some.groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, q1 and q3 of each rate) of a sketch that is merged to these keys."""
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    up = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin")))
    q = up.groupBy(*keys, "rate").agg(at(1).alias("q1"), at(3).alias("q3"), F.first("total").alias("docs"))
    picked = [F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{r}_{c}") for r in SLACK for c in ("q1", "q3")]
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), *picked)


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <rate>_low, <rate>_high), by the smallest group that has enough documents."""
    own = _quartiles(sketch, ["lang", "source"])
    values = [c for c in own.columns if c not in ("lang", "source", "docs")]
    wider = lambda keys, tag: _quartiles(sketch, keys).select(
        *[F.col(k).alias(f"{tag}_{k}") for k in keys], F.col("docs").alias(f"{tag}_docs"), *[F.col(c).alias(f"{tag}_{c}") for c in values]
    )
    # A row for each pair of language and source on the left; one per language, and one in all, on the right.
    both = own.withColumn("all", F.lit(1)).join(wider(["lang"], "l"), F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(wider([], "a").withColumn("all", F.lit(1))), "all")
    pick = lambda c: F.when(F.col("docs") >= LEAST, F.col(c)).when(F.col("l_docs") >= LEAST, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    out = []
    for rate, (above, under) in SLACK.items():
        q1, q3 = pick(f"{rate}_q1"), pick(f"{rate}_q3")
        out.append((q3 + SPREAD * (q3 - q1) + above).alias(f"{rate}_high"))
        out.append((q1 - SPREAD * (q3 - q1) - under if under is not None else F.lit(0)).cast("long").alias(f"{rate}_low"))
    return both.select("lang", "source", *out)


def judged(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", p: str = "__") -> DataFrame:
    """``measured``, a written table, with base_failed and kept, named with ``p`` before."""
    limits = written(fences(written(sketches(measured, lang_col, source_col, p), "sketch")), "fences")
    # Null-safe equality as equality of never-null keys.
    tag = lambda c: F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))
    limits = limits.select(tag(F.col("lang")).alias(p + "lang"), tag(F.col("source")).alias(p + "source"), *[F.col(c).alias(p + c) for c in limits.columns[2:]])
    keyed = measured.withColumns({p + "lang": tag(col(lang_col)), p + "source": tag(col(source_col))})
    joined = join_small(keyed, limits, [p + "lang", p + "source"], "left")
    failed = (F.col(p + "n_words") < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(p + "n_words"))
    within = F.lit(True)
    for rate, value in _rates(p).items():
        within &= F.coalesce(value.between(F.col(f"{p}{rate}_low"), F.col(f"{p}{rate}_high")), F.lit(False))
    return joined.withColumns({p + "base_failed": failed, p + "kept": ~failed & within})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base numbers, base_failed and kept."""
    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang"), col(source_col).alias("source"))
    measured = written(with_measures(slim).drop("text"), "measures")
    return judged(measured).select("doc_id", *[F.col(f"__{c}").alias(c) for c in [*BASE, "base_failed", "kept"]])


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; texts are measured once and read back with their measures."""
    p = prefix(docs.columns)
    measured = written(with_measures(docs, text_col, p), "measured")
    return own(judged(measured, lang_col, source_col, p).filter(F.col(p + "kept")), docs.columns)


def _sql_fence(rate: str) -> str:
    above, under = SLACK[rate]
    low = f"q1 - {SPREAD} * (q3 - q1) - {under}" if under is not None else "0"
    return f"WHEN '{rate}' THEN v BETWEEN {low} AND q3 + {SPREAD} * (q3 - q1) + {above}"


#: The same in DuckDB SQL.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t)),
five AS (
  SELECT r, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g, lead(word, 4) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM five WHERE whole) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT r, sum(n) AS n_lines, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN n - 1 ELSE 0 END) AS n_dup_lines
  FROM (SELECT r, line, count(*) AS n FROM l GROUP BY r, line) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines
  FROM t LEFT JOIN counts USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
rates AS (
  SELECT r, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'length']) AS rate,
         unnest([1000 * n_symbols // greatest(word_chars, 1), (1000 * n_dup_lines // greatest(n_lines, 1))::BIGINT, 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) AS v
  FROM m WHERE n_words > 0),
sk AS (SELECT lang, source, rate, v - v % (2 ** greatest(length(bin(v)) - {BITS}, 0))::BIGINT AS b, count(*) AS n FROM rates GROUP BY ALL),
levels AS (
  SELECT 0 AS lv, lang, source, rate, b, n FROM sk UNION ALL
  SELECT 1, lang, NULL, rate, b, sum(n) FROM sk GROUP BY lang, rate, b UNION ALL
  SELECT 2, NULL, NULL, rate, b, sum(n) FROM sk GROUP BY rate, b),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, rate ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, rate) AS total FROM levels),
q AS (
  SELECT lv, lang, source, rate, min(CASE WHEN 4 * upto >= total THEN b END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN b END) AS q3, max(total) AS docs
  FROM cum GROUP BY lv, lang, source, rate),
ok AS (
  SELECT r, bool_and(CASE rate {' '.join(_sql_fence(k) for k in SLACK)} END) AS within FROM (
    SELECT x.r, x.rate, x.v, CASE WHEN q0.docs >= {LEAST} THEN q0.q1 WHEN ql.docs >= {LEAST} THEN ql.q1 ELSE qa.q1 END AS q1,
           CASE WHEN q0.docs >= {LEAST} THEN q0.q3 WHEN ql.docs >= {LEAST} THEN ql.q3 ELSE qa.q3 END AS q3
    FROM rates x
    JOIN q q0 ON q0.lv = 0 AND q0.lang IS NOT DISTINCT FROM x.lang AND q0.source IS NOT DISTINCT FROM x.source AND q0.rate = x.rate
    JOIN q ql ON ql.lv = 1 AND ql.lang IS NOT DISTINCT FROM x.lang AND ql.rate = x.rate
    JOIN q qa ON qa.lv = 2 AND qa.rate = x.rate)
  GROUP BY r),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, false) AS kept
FROM base LEFT JOIN ok USING (r)"""
