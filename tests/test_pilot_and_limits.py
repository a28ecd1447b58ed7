"""The table of runs, readers with limits, and thresholds from documents."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators import contracts, cost
from pairloom.sources import readers, writers


def parts(spark, **training):
    variants = spark.createDataFrame([("a", "gold", "random"), ("b", "llm_teacher", "active")], "variant string, label_source string, selection_strategy string")
    targets = variants.withColumns({"teacher_model": F.when(F.col("variant") == "b", "t"), "estimated_cost_usd": F.when(F.col("variant") == "b", F.lit(0.5))})
    targets = targets.unionByName(targets)
    metrics = spark.createDataFrame([("a", 0.5, 0.5, 0.5), ("b", 0.25, 0.5, 0.75)], "variant string, same_f1 double, macro_f1 double, accuracy double")
    trained = variants.select("variant", F.lit("wall").alias("training_time_scope"), F.lit(7200.0).alias("training_wall_seconds"))
    return variants, targets, metrics, trained


def test_pilot_table(spark):
    variants, targets, metrics, trained = parts(spark)
    table = cost.pilot_table(variants, targets, metrics, trained, 2, allow_partial=True)
    assert tuple(table.columns) == cost.PILOT_COLUMNS and len(cost.PILOT_COLUMNS) == 34
    rows = {r.variant: r for r in table.collect()}
    assert rows.keys() == {"a_student", "b_student"}
    assert (rows["b_student"].teacher_label_cost_usd, rows["b_student"].teacher_model, rows["b_student"].training_gpu_hours) == (1.0, "t", 2.0)
    assert (rows["a_student"].teacher_label_cost_usd, rows["a_student"].student_architecture) == (0.0, "seq2seq")
    assert rows["a_student"].same_f1_delta_vs_gold_random is None


def test_pilot_table_errors(spark):
    variants, targets, metrics, trained = parts(spark)
    with pytest.raises(FileNotFoundError, match="direct"):
        cost.pilot_table(variants, targets, metrics, trained, 2)
    with pytest.raises(FileNotFoundError, match="b: metrics"):
        cost.pilot_table(variants, targets, metrics.filter("variant = 'a'"), trained, 2, trained.limit(0))
    some = cost.pilot_table(variants, targets, metrics, trained, 2, included=["a"], allow_partial=True)
    assert [r.variant for r in some.collect()] == ["a_student"]
    for bad, what in (
        ((variants, targets, metrics, trained, 3), "number of targets"),
        ((variants, targets.withColumn("estimated_cost_usd", F.lit(-1.0)), metrics, trained, 2), "label costs"),
        ((variants, targets.withColumn("label_source", F.lit("gold")), metrics, trained, 2), "b: label_source"),
        ((variants, targets, metrics.withColumn("architecture", F.lit("other")), trained, 2), "model by architecture"),
        ((variants, targets, metrics, trained.withColumn("student_id", F.lit("s")), 2), "model by student_id"),
        ((variants, targets, metrics, trained.withColumn("training_time_scope", F.lit("")), 2), "training_time_scope"),
    ):
        with pytest.raises(ValueError, match=what):
            cost.pilot_table(*bad, allow_partial=True)


def test_first_lines_count_blank_ones(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "split": "train"}\n\n{"a": 2, "split": "test"}\n{"a": 3, "split": "train"}\n')
    schema = "a int, split string"
    assert [r.a for r in readers.first_json_lines(spark, str(path), schema, 3).orderBy("a").collect()] == [1, 2]
    assert [r.a for r in readers.target_rows(spark, str(path), schema, "train").orderBy("a").collect()] == [1, 3]
    assert readers.target_rows(spark, str(path), schema).count() == 3
    contracts.expect_rows(readers.target_rows(spark, str(path), schema), 3, "targets")
    with pytest.raises(ValueError, match="3 rows instead of 2"):
        contracts.expect_rows(readers.target_rows(spark, str(path), schema), 2, "targets")
    (tmp_path / "none.jsonl").write_text("")
    assert readers.numbered_json_lines(spark, str(tmp_path / "none.jsonl"), schema).collect() == []


def test_threshold_document(spark, tmp_path):
    assert readers.decision_threshold(spark, str(tmp_path / "none")) == 0.5
    for value in (0.25, 1.5):
        writers.write_document(spark.createDataFrame([(value,)], "decision_threshold double"), str(tmp_path / str(value)))
    assert readers.decision_threshold(spark, str(tmp_path / "0.25")) == 0.25
    with pytest.raises(ValueError, match="between 0 and 1"):
        readers.decision_threshold(spark, str(tmp_path / "1.5"))
