"""Multi-party dialogues, rendered once from each participant's side. SQL functions only.

From a participant's side the own turns are the assistant's and trained on; those
of the others are users' turns under their names. Instructions are nobody's turn.
The mask tells by lengths which characters are targets: "18:0,25:1" are 18 that are
not and 25 that are. A target is the assistant's text and its end mark.

A conversation of ordinary size is one row per participant (part 0). One with more
than ``MOST_TURNS`` turns or ``MOST_CHARS`` characters is sorted and rendered in
stretches of its turns, by many tasks. With ``whole`` the finished stretches of a
participant are put together to one row (part 0), as at any other size; a task then
holds one dialogue's text, which must be under 2 GB as any string of Spark. Else
each stretch is a row, in the order of ``part``.

Defined cases: turns are ordered by turn, role and text, so repeated turn numbers
and repeated rows all stay. A null turn comes first, a null role is the name "", a
null text is empty. Rows without conv_id are one conversation. One of instructions
only has no participant and no row. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import written

INSTRUCTIONS = ("system",)
MOST_TURNS, MOST_CHARS, STRETCH = 2000, 20_000_000, 500
END = "<|end|>\n"


def _rendered(turns: DataFrame, names: Column, instructions: tuple[str, ...], keys: list[str]) -> DataFrame:
    """turns: keys and ``said``, the sorted turns of a dialogue or stretch."""
    sides = turns.select(*keys, "said", F.explode(names).alias("perspective"))

    def segment(t: Column) -> Column:
        mine = t["role"] == F.col("perspective")
        head = F.when(mine, F.lit("<|assistant|>\n")).when(t["role"].isin(*instructions), F.concat(F.lit("<|"), t["role"], F.lit("|>\n")))
        return F.struct(F.coalesce(head, F.concat(F.lit('<|user name="'), t["role"], F.lit('"|>\n'))).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine.alias("mine"))

    cut = sides.withColumn("cut", F.transform("said", segment))
    marks = F.transform("cut", lambda s: F.concat(F.length(s["head"]).cast("string"), F.lit(":0,"), F.length(s["body"]).cast("string"), F.when(s["mine"], F.lit(":1")).otherwise(F.lit(":0"))))
    return cut.select(
        *keys,
        "perspective",
        F.size("cut").cast("long").alias("n_turns"),
        F.array_join(F.transform("cut", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.array_join(marks, ",").alias("mask"),
    )


def _put_together(parts: DataFrame) -> DataFrame:
    """One row per conversation and participant of the finished stretches."""
    rows = parts.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("part", "rendered", "mask"))).alias("s"))
    return rows.select("conv_id", F.lit(0).cast("long").alias("part"), "perspective", "n_turns", F.array_join("s.rendered", "").alias("rendered"), F.array_join("s.mask", ",").alias("mask"))


def rotate_perspectives(
    conversations: DataFrame,
    instructions: tuple[str, ...] = INSTRUCTIONS,
    most_turns: int = MOST_TURNS,
    most_chars: int = MOST_CHARS,
    stretch: int = STRETCH,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    whole: bool = False,
) -> DataFrame:
    """conv_id, part, perspective, n_turns, rendered, mask: a row per participant and part; ``whole``: always one part."""
    turns = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("t.text")).alias("chars"))
    large = written(sizes.filter((F.col("n") > most_turns) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("large_id"), "n", "chars"), "large")
    n_large = large.count()
    keys = ["conv_id", "part"]
    speakers = lambda roles: F.array_sort(F.array_except(roles, F.array(*[F.lit(x) for x in instructions])))

    def ordinary(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("said")).withColumn("part", F.lit(0).cast("long"))
        return _rendered(whole, speakers(F.array_distinct(F.transform("said", lambda t: t["role"]))), instructions, keys)

    if not n_large:
        return ordinary(turns)
    # The large ones: few rows are broadcast, many are joined by a shuffle.
    side = F.broadcast(large) if n_large <= 10_000 else large
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    rest = ordinary(turns.join(side.select("large_id"), same, "left_anti"))
    # A turn's place: the sorted order, found without gathering the conversation. Ranges of the whole
    # order go to tasks, a task numbers its own rows, and only the counts of the ranges are added up.
    spread = turns.join(side, same).drop("large_id").withColumn("limit", F.least(F.lit(stretch), F.floor(F.col("n") * most_chars / F.greatest("chars", F.lit(1)) / 4) + 1))
    n_ranges = max(1, int(large.agg(F.sum("n")).first()[0]) // (4 * most_turns) + 1)
    ranged = spread.repartitionByRange(n_ranges, "conv_id", "t", F.rand(7)).sortWithinPartitions("conv_id", "t")
    ranged = written(ranged.select("conv_id", "t", "limit", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "ranged")
    # Within a range the running number is the row id less the first one of that conversation there.
    firsts = ranged.groupBy("conv_id", "p").agg(F.min("m").alias("first"), F.count("*").alias("in_range"))
    before = firsts.alias("a").join(firsts.select(F.col("conv_id").alias("c2"), F.col("p").alias("p2"), F.col("in_range").alias("r2")).alias("b"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("p2") < F.col("p")), "left")
    starts = before.groupBy("conv_id", "p", "first").agg(F.coalesce(F.sum("r2"), F.lit(0)).alias("start")).select(F.col("conv_id").alias("c3"), F.col("p").alias("p3"), "first", "start")
    placed = ranged.join(starts, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("p") == F.col("p3")))
    placed = placed.withColumn("part", F.floor((F.col("start") + F.col("m") - F.col("first")) / F.col("limit")).cast("long"))
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("said"))
    names = turns.join(side.select("large_id"), same, "left_semi").groupBy("conv_id").agg(F.collect_set("t.role").alias("roles")).withColumnRenamed("conv_id", "named")
    named = parts.join(names, F.col("conv_id").eqNullSafe(F.col("named")))
    stretches = _rendered(named, speakers(F.col("roles")), instructions, keys)
    return rest.unionByName(_put_together(stretches) if whole else stretches)


#: The same in DuckDB SQL, with ``whole``.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, perspective, turn, role, text || '<|end|>' || chr(10) AS body, role = perspective AS mine,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name="' || role || '"|>' END || chr(10) AS head
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id)
SELECT conv_id, 0::BIGINT AS part, perspective, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, body) AS rendered,
       string_agg(length(head) || ':0,' || length(body) || CASE WHEN mine THEN ':1' ELSE ':0' END, ',' ORDER BY turn, role, body) AS mask
FROM s GROUP BY conv_id, perspective"""
