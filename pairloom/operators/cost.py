"""Result tables of several runs: union, deltas to reference runs, and cost scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.numbers import is_amount

#: Compared measures, and reference runs by the name that their columns get.
COMPARED = ("same_f1", "macro_f1", "accuracy")
REFERENCES = {"llm_random": "llm_random_student", "gold_random": "gold_random_student"}

#: The columns of the table of runs, in order.
PILOT_COLUMNS = (
    "variant", "student_id", "student_model_name", "student_architecture", "train_label_source", "budget", "selection_strategy", "teacher_model",
    "teacher_label_cost_usd", "direct_llm_inference_cost_usd", "training_time_scope", "training_wall_seconds", "training_gpu_hours",
    "student_inference_seconds", "student_inference_rows_per_second", "student_inference_seconds_per_pair", "inference_device_name", "inference_batch_size",
    "same_precision", "same_recall", "same_f1", "macro_f1", "accuracy", "invalid_output_rate", "tp", "fp", "tn", "fn",
    "same_f1_delta_vs_llm_random", "macro_f1_delta_vs_llm_random", "accuracy_delta_vs_llm_random",
    "same_f1_delta_vs_gold_random", "macro_f1_delta_vs_gold_random", "accuracy_delta_vs_gold_random",
)
#: What a run was trained as where its summary does not say.
IDENTITY = {"student_id": "flan-t5-base", "model_name": "google/flan-t5-base", "architecture": "seq2seq"}


def union_runs(students: DataFrame, direct: DataFrame) -> DataFrame:
    return students.unionByName(direct, allowMissingColumns=True)


def with_deltas(runs: DataFrame) -> DataFrame:
    """Each student's measures less those of the reference runs; null where either is missing.

    The reference values are one row, by a conditional aggregate, joined on a constant.
    """
    values = [F.max(F.when(F.col("variant") == v, F.col(m))).alias(f"__{k}_{m}") for k, v in REFERENCES.items() for m in COMPARED]
    reference = runs.agg(*values).withColumn("__one", F.lit(1))
    student = F.col("variant").endswith("_student")
    deltas = {f"{m}_delta_vs_{k}": F.when(student, F.col(m) - F.col(f"__{k}_{m}")) for k in REFERENCES for m in COMPARED}
    both = runs.withColumn("__one", F.lit(1)).join(F.broadcast(reference), "__one")
    return both.withColumns(deltas).drop("__one", *[f"__{k}_{m}" for k in REFERENCES for m in COMPARED])


def _checked(value: Column, what: str) -> Column:
    return F.when(is_amount(value), value).otherwise(F.raise_error(F.lit(f"{what} must be finite and non-negative")).cast("double"))


def cost_scenarios(students: DataFrame, scenarios: DataFrame, direct: DataFrame) -> DataFrame:
    """Every student under every GPU price against the direct labeller.

    students: variant, teacher_label_cost_usd, training_time_scope,
    training_wall_seconds, student_inference_seconds_per_pair; scenarios: scenario,
    currency, usd_per_gpu_hour; direct (one row): total_cost_usd, evaluated_pairs.
    """
    paid = direct.select(
        F.lit(1).alias("one"),
        _checked(F.col("total_cost_usd").cast("double"), "direct_total_cost_usd").alias("direct_total"),
        F.when(F.col("evaluated_pairs") > 0, F.col("evaluated_pairs")).otherwise(F.raise_error(F.lit("direct_evaluated_pairs must be positive")).cast("long")).alias("n"),
    )
    priced = scenarios.select("scenario", "currency", _checked(F.col("usd_per_gpu_hour").cast("double"), "GPU-hour rate").alias("rate"), F.lit(1).alias("one"))
    timed = students.select(
        "variant",
        "training_time_scope",
        _checked(F.coalesce("teacher_label_cost_usd", F.lit(0.0)), "teacher-label cost").alias("teacher"),
        (_checked(F.col("training_wall_seconds").cast("double"), "training time") / 3600.0).alias("train_h"),
        (_checked(F.col("student_inference_seconds_per_pair").cast("double"), "inference time") / 3600.0).alias("infer_h"),
        F.lit(1).alias("one"),
    )
    # Scenarios and the direct row are a few rows that a person has written.
    both = timed.join(F.broadcast(priced), "one").join(F.broadcast(paid), "one")
    c = F.col
    sums = both.withColumns({"train": c("train_h") * c("rate"), "infer": c("infer_h") * c("rate"), "direct_each": c("direct_total") / c("n")})
    sums = sums.withColumns({"upfront": c("teacher") + c("train"), "gain": c("direct_each") - c("infer")})
    sums = sums.withColumn("total", c("upfront") + c("n") * c("infer"))
    return sums.select(
        "scenario",
        "currency",
        c("rate").alias("usd_per_gpu_hour"),
        "variant",
        c("teacher").alias("teacher_label_cost_usd"),
        "training_time_scope",
        c("train_h").alias("training_gpu_hours"),
        c("train").alias("training_cost_usd"),
        c("infer_h").alias("student_inference_gpu_hours_per_pair"),
        c("infer").alias("student_inference_cost_per_pair_usd"),
        c("upfront").alias("student_upfront_cost_usd"),
        c("direct_each").alias("direct_llm_cost_per_pair_usd"),
        F.when(c("gain") > 0, F.ceil(c("upfront") / c("gain"))).alias("break_even_queries"),
        c("n").alias("comparison_pairs"),
        c("total").alias("student_total_cost_at_comparison_scale_usd"),
        c("direct_total").alias("direct_llm_total_cost_at_comparison_scale_usd"),
        (c("direct_total") - c("total")).alias("savings_at_comparison_scale_usd"),
    )


def assembled(variants: DataFrame, targets: DataFrame, metrics: DataFrame, training: DataFrame, included: Sequence[str] | None = None) -> DataFrame:
    """Each variant with its parts, and ``missing``: the names of the parts that it lacks.

    targets: variant, n_targets; metrics and training: variant and their columns. A
    variant outside ``included`` lacks its current contract and gets no parts.
    """
    out = variants.select("variant")
    allowed = F.lit(True) if included is None else F.col("variant").isin(*included)
    for name, part in (("targets", targets), ("metrics", metrics), ("training", training)):
        out = out.join(part.withColumn(f"has_{name}", F.lit(True)), "variant", "left")
    lacks = [F.when(allowed & F.col(f"has_{n}").isNull(), F.lit(n)) for n in ("targets", "metrics", "training")]
    missing = F.array_compact(F.array(F.when(~allowed, F.concat(F.lit("current_contract:"), "variant")), *lacks))
    return out.withColumn("missing", missing).drop("has_targets", "has_metrics", "has_training")


def identity_mismatches(training: DataFrame, metrics: DataFrame, fields: Sequence[str] = ("student_id", "model_name", "architecture")) -> DataFrame:
    """(variant, field, expected, observed) where two documents of a run name different models."""
    both = training.alias("t").join(metrics.alias("m"), "variant")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("expected"), F.col(f"m.{f}").alias("observed")) for f in fields]))
    return both.select("variant", each.alias("x")).select("variant", "x.*").filter("observed IS NOT NULL AND NOT (expected <=> observed)")


def distinct_models(runs: DataFrame) -> DataFrame:
    """One row: how many different models the runs name (more than one is a mix of runs)."""
    return runs.agg(F.count_distinct(F.struct("student_id", "student_model_name", "student_architecture")).alias("n_models"))


def pilot_table(
    variants: DataFrame, targets: DataFrame, metrics: DataFrame, training: DataFrame, budget: int, direct: DataFrame | None = None, included: Sequence[str] | None = None, allow_partial: bool = False
) -> DataFrame:
    """One row a student run and one for the direct labeller, in ``PILOT_COLUMNS``.

    variants: variant, label_source, selection_strategy (what is expected of each);
    targets: variant, label_source, selection_strategy, teacher_model,
    estimated_cost_usd; metrics and training: one row a variant, with the columns that
    they have; direct: the labeller's row. The targets are aggregated by variant; all
    else is a row a run. A run without all parts is left out if ``allow_partial``, and
    an error otherwise; parts that contradict each other are always an error.
    """
    cost, source = F.col("estimated_cost_usd"), F.col("label_source")
    same = ("label_source", "selection_strategy", "teacher_model")
    counted = targets.groupBy("variant").agg(
        F.count("*").alias("n_targets"),
        F.sum(F.coalesce(cost, F.lit(0.0))).alias("teacher_label_cost_usd"),
        F.count_if((cost.isNull() & (source == "llm_teacher")) | ~is_amount(F.coalesce(cost, F.lit(0.0)))).alias("bad_costs"),
        *[f(F.nullif(F.col(c), F.lit(""))).alias(f"{k}_{c}") for c in same for k, f in (("least", F.min), ("most", F.max))],
    )
    told = [c for c in IDENTITY if c in training.columns]
    trained = training.select("variant", "training_time_scope", "training_wall_seconds", *[(F.col(c) if c in told else F.lit(None).cast("string")).alias(f"trained_{c}") for c in IDENTITY])
    seen = metrics.withColumns({f"seen_{c}": F.col(c) if c in metrics.columns else F.lit(None).cast("string") for c in IDENTITY}).drop(*IDENTITY)
    expected = variants.select("variant", F.col("label_source").alias("wanted_source"), F.col("selection_strategy").alias("wanted_strategy"))
    runs = assembled(variants, counted, seen, trained, included).join(expected, "variant")
    configured = F.col("trained_student_id").isNotNull() | F.col("trained_architecture").isNotNull()
    identity = {c: F.coalesce(f"trained_{c}", F.lit(v)) for c, v in IDENTITY.items()}
    strategy = F.coalesce("least_selection_strategy", "wanted_strategy")
    faults = {
        "number of targets": F.col("n_targets") != budget,
        "label costs": F.col("bad_costs") > 0,
        "label_source": ~F.col("least_label_source").eqNullSafe(F.col("wanted_source")),
        "selection_strategy": ~strategy.eqNullSafe(F.col("wanted_strategy")),
        "training_wall_seconds": F.col("training_wall_seconds").isNull(),
        "training_time_scope": F.coalesce(F.col("training_time_scope") == "", F.lit(True)),
        **{f"several values of {c}": F.col(f"least_{c}") != F.col(f"most_{c}") for c in same},
        **{f"model by {c}": F.when(F.col(f"seen_{c}").isNull(), configured).otherwise(F.col(f"seen_{c}") != identity[c]) for c in IDENTITY},
    }
    wrong = F.array_compact(F.array(*[F.when(bad, F.lit(what)) for what, bad in faults.items()]))
    # A row a variant: their number is the caller's.
    found = runs.select("variant", "missing", F.when(F.size("missing") == 0, wrong).alias("wrong"), F.when(F.size("missing") == 0, F.struct(*[v.alias(c) for c, v in identity.items()])).alias("model")).collect()
    if bad := sorted(f"{r.variant}: {', '.join(r.wrong)}" for r in found if r.wrong):
        raise ValueError(f"runs whose parts disagree: {'; '.join(bad)}")
    if len({r.model for r in found if r.model}) > 1:
        raise ValueError("the runs are of several models")
    lacking = sorted(f"{r.variant}: {', '.join(r.missing)}" for r in found if r.missing) + ["direct"] * (direct is None)
    if lacking and not allow_partial:
        raise FileNotFoundError(f"missing parts of runs: {'; '.join(lacking)}")
    students = runs.filter(F.size("missing") == 0).withColumns(
        {
            "variant": F.concat("variant", F.lit("_student")),
            "student_id": identity["student_id"],
            "student_model_name": identity["model_name"],
            "student_architecture": identity["architecture"],
            "train_label_source": F.col("least_label_source"),
            "budget": F.lit(budget).cast("long"),
            "selection_strategy": strategy,
            "teacher_model": F.col("least_teacher_model"),
            "training_gpu_hours": F.col("training_wall_seconds") / 3600.0,
        }
    )
    table = with_deltas(students if direct is None else union_runs(students, direct))
    return table.select(*[F.col(c) if c in table.columns else F.lit(None).cast("double").alias(c) for c in PILOT_COLUMNS])
