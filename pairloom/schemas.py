"""Schemas of the tables as DDL texts, and the rules for their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDE = "id_{0} BIGINT, title_{0} STRING, brand_{0} STRING, description_{0} STRING, price_{0} STRING, priceCurrency_{0} STRING, cluster_id_{0} BIGINT"
RAW_PAIR = f"{_SIDE.format('left')}, {_SIDE.format('right')}, pair_id STRING, label INT, is_hard_negative BOOLEAN"

RECORD = "STRUCT<record_id: STRING, entity_id: STRING, source: STRING, attributes: MAP<STRING, STRING>>"
PAIR = (
    f"pair_id STRING, split STRING, label INT, target_label STRING, input_text STRING, record_a {RECORD}, record_b {RECORD}, "
    "metadata STRUCT<dataset: STRING, is_hard_negative: BOOLEAN, cluster_id_left: STRING, cluster_id_right: STRING>"
)
SELECTION = (
    "selection_strategy STRING, selection_rank INT, selection_score DOUBLE, selection_seed INT, selection_uses_gold_label BOOLEAN, "
    "selection_bucket STRING, selection_bucket_rank INT, selection_bucket_quota INT"
)
CACHE = (
    f"pair_id STRING, dataset STRING, split STRING, budget STRING, {SELECTION}, teacher_model STRING, prompt_version STRING, raw_answer STRING, "
    "label STRING, valid BOOLEAN, error STRING, input_tokens BIGINT, output_tokens BIGINT, estimated_cost_usd DOUBLE, mode STRING, gold_label STRING, "
    "response_model STRING, provider_response_id STRING, created_at STRING, metadata MAP<STRING, STRING>"
)
PREDICTION = (
    "pair_id STRING, label STRING, prediction_text STRING, prediction INT, is_valid BOOLEAN, non_match_probability DOUBLE, match_probability DOUBLE"
)

LABELS = ("match", "non_match")
MODES = ("teacher_label", "direct_prediction")


def _broken(direct: bool) -> dict[str, Column]:
    """The rules of cache rows by name: true where a row breaks one."""
    c = F.col
    rules: dict[str, Column] = {f"{n}_missing": c(n).isNull() | (c(n) == "") for n in ("pair_id", "dataset", "teacher_model", "prompt_version", "created_at")}
    rules |= {f"{n}_below_1": c(n) < 1 for n in ("selection_rank", "selection_bucket_rank")}
    rules |= {f"{n}_negative": c(n) < 0 for n in ("selection_bucket_quota", "input_tokens", "output_tokens", "estimated_cost_usd")}
    rules |= {f"{n}_unknown": ~c(n).isin(*LABELS) for n in ("label", "gold_label")}
    rules["mode_unknown"] = c("mode").isNull() | ~c("mode").isin(*MODES)
    rules["valid_missing"] = c("valid").isNull()
    rules["valid_without_label"] = c("valid") & c("label").isNull()
    rules["label_without_valid"] = ~c("valid") & c("label").isNotNull()
    if direct:
        rules["gold_label_missing"] = c("gold_label").isNull()
        rules["mode_other"] = c("mode") != "direct_prediction"
    return rules


def cache_violations(direct: bool = False) -> Column:
    """Names of the rules that a cache row breaks; an empty array for a good row."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in _broken(direct).items()]))


def keeps_rules(direct: bool = False) -> Column:
    """Whether ``cache_violations`` are none, without naming them."""
    return reduce(lambda a, b: a & b, [~F.coalesce(broken, F.lit(False)) for broken in _broken(direct).values()])


def with_violations(rows: DataFrame, direct: bool = False) -> DataFrame:
    return rows.withColumn("violations", cache_violations(direct))
