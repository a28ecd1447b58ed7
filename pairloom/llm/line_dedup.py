"""Removal of globally repeated runs of lines, as content-defined chunks. SQL functions only.

A text is cut between its lines. A chunk ends after a line where a rolling hash of
the hashes of that line and the one before it is divisible by ``DIVISOR``, and
before and after a line of ``LONG_WORDS`` words or more, which is a passage by
itself. So where a chunk ends depends on two lines only, and text that is put in
or left out elsewhere does not move the ends.

Chunks of two lines or more, and long lines, are repeated if another place holds
the same bytes: they are grouped by their bytes, not by a hash alone. Of such
places the one in the document with the smallest doc_id stays, the first one in
that document, and the others go. Single short lines always stay.

Only short keys are joined, of two independent 64-bit hashes. One that stands for two
byte strings all the same would be noticed when the bytes are grouped, and its chunks
would stay.

Defined cases: a null text stays null, with no lines; an empty text has one empty
line. Rows without doc_id come after all others. Rows that share a doc_id count as
one document when it is asked which document keeps a chunk; rows that repeat both
doc_id and text are treated alike. Other columns are kept as they are, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import col, fresh, prefix, written

DIVISOR = 3
LONG_WORDS = 50
NO_ID = (1 << 63) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """The chunks of a text in order: array<struct<body, lines, passage>>."""
    number = lambda v: F.lit(v).cast("int")

    def cut(lines: Column) -> Column:
        marks = F.transform(
            lines,
            lambda x: F.struct(_line_hash(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) >= long_words - 1).alias("long")),
        )
        return _let(marks, lambda m: _let(ends(lines, m), lambda e: bodies(lines, m, e)))

    def ends(lines: Column, marks: Column) -> Column:
        last = F.size(lines) - 1

        def is_end(i: Column) -> Column:
            rolled = marks[i]["h"] + F.when(i > 0, 31 * marks[F.greatest(i - 1, number(0))]["h"]).otherwise(0)
            return (i == last) | marks[i]["long"] | marks[F.least(i + 1, last)]["long"] | (rolled % divisor == 0)

        return F.filter(F.sequence(number(0), last), is_end)

    def bodies(lines: Column, marks: Column, ends: Column) -> Column:
        def body(end: Column, k: Column) -> Column:
            start = F.when(k > 0, ends[F.greatest(k - 1, number(0))] + 1).otherwise(number(0))
            return F.struct(
                F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("body"),
                (end - start + 1).alias("lines"),
                ((end > start) | marks[end]["long"]).alias("passage"),
            )

        return F.transform(ends, body)

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), cut))


def _key(body: Column) -> Column:
    """Two independent 64-bit hashes of a chunk."""
    return F.struct(F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g"))


def _marked(parts: Column) -> Column:
    """(k, key, again) of the chunks that count as passages; again: the text has it before."""
    numbered = F.filter(
        F.transform(parts, lambda c, k: F.struct(_key(c["body"]).alias("key"), k.alias("k"), c["passage"].alias("passage"))), lambda c: c["passage"]
    )
    return _let(
        F.array_sort(numbered),
        lambda s: F.transform(
            s, lambda c, i: F.struct(c["k"].alias("k"), c["key"].alias("key"), ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["key"] == c["key"])).alias("again"))
        ),
    )


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated chunks taken out of their texts.

    Two columns are added at the end: n_lines (of the text as it came) and
    n_removed_lines, each with ``_`` before it if ``docs`` has that name.
    """
    p, text = prefix(docs.columns), col(text_col)
    n_lines, n_removed = fresh(docs.columns, "n_lines", "n_removed_lines")
    key = F.coalesce(col(id_col).cast("long"), F.lit(NO_ID))
    slim = docs.filter(text.isNotNull()).select(key.alias("id"), text.alias("text"))
    cut = slim.select("id", F.xxhash64("text").alias("print"), chunks(F.col("text"), divisor, long_words).alias("parts"))

    said = cut.select("id", F.explode("parts").alias("c")).filter("c.passage").select("id", _key(F.col("c.body")).alias("key"), F.col("c.body").alias("body"))
    equal = said.groupBy("key", "body").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
    repeated = equal.groupBy("key").agg(F.count("*").alias("bodies"), F.max("n").alias("n"), F.min("keeper").alias("keeper")).filter("n > 1 AND bodies = 1")
    # Written first: a join of two shuffled tables is one whose hot keys Spark can split, or broadcast if they are few.
    repeated = written(repeated.select("key.h", "key.g", "keeper"), "repeated")

    places = cut.select("id", "print", F.explode(_marked(F.col("parts"))).alias("m")).select("id", "print", "m.k", "m.key.h", "m.key.g", "m.again")
    gone = places.join(repeated, ["h", "g"]).filter("id > keeper OR again")
    # A document's list has at most one number for each of its chunks.
    lists = gone.groupBy("id", "print").agg(F.collect_set("k").alias("gone")).select(F.col("id").alias(p + "id"), F.col("print").alias(p + "print"), F.col("gone").alias(p + "gone"))

    joined = docs.join(lists, (key == F.col(p + "id")) & (F.xxhash64(text) == F.col(p + "print")), "left")

    def kept(parts: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(p + "gone")), lambda k: parts[k])

    left = F.when(F.col(p + "gone").isNotNull(), _let(chunks(text, divisor, long_words), kept))
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    with_left = joined.withColumns({n_lines: lines, p + "left": left})
    rest = F.col(p + "left")
    still = F.aggregate(rest, F.lit(0).cast("long"), lambda n, c: n + c["lines"])
    shorter = F.when(rest.isNotNull(), F.array_join(F.transform(rest, lambda c: c["body"]), "\n")).otherwise(text)
    removed = F.when(rest.isNotNull(), F.col(n_lines) - still).otherwise(0).cast("long")
    return with_left.select(*[shorter.alias(c) if c == text_col else col(c) for c in docs.columns], n_lines, removed.alias(n_removed))


#: The same in DuckDB SQL, for the columns that the registered query returns.
SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) >= {LONG_WORDS - 1} AS long
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), ends AS (
  SELECT *, long OR coalesce(lead(long) OVER w, true) OR (h + 31 * coalesce(lag(h) OVER w, 0)) % {DIVISOR} = 0 AS is_end
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends
), parts AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n, count(*) > 1 OR bool_or(long) AS passage FROM numbered GROUP BY doc_id, k
), judged AS (
  SELECT *, passage AND row_number() OVER (PARTITION BY body, passage ORDER BY doc_id, k) > 1 AS gone FROM parts
)
SELECT d.doc_id, coalesce(any_value(t.n_lines), 0)::BIGINT AS n_lines, coalesce(any_value(t.removed), 0)::BIGINT AS n_removed_lines,
       any_value(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.body, '') END) AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END) AS removed, string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS body
  FROM judged GROUP BY doc_id) t USING (doc_id)
GROUP BY d.doc_id"""
