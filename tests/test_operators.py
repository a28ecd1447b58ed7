"""Operators on small tables, and the errors that they must raise."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions.features import BUCKETS
from pairloom.operators import contracts, cost, labels, metrics, selection, summary


def scored(spark, n, seed=0, ties=5):
    rnd = random.Random(seed)
    return spark.createDataFrame([(f"{i}", *[rnd.randint(0, ties) / ties for _ in BUCKETS]) for i in range(n)], "pair_id string, " + ", ".join(f"score_{b} double" for b in BUCKETS))


@pytest.mark.parametrize(("n", "budget", "limit"), [(200, 40, 1000), (200, 200, 1000), (50, 13, 5)])
def test_buckets_equal_a_plain_loop(spark, monkeypatch, n, budget, limit):
    monkeypatch.setattr(selection, "WINDOW_LIMIT", limit)
    df = scored(spark, n)
    rows, quotas, taken, want = df.collect(), selection.bucket_quotas(budget), set(), []
    for b in BUCKETS:
        free = sorted((r for r in rows if r.pair_id not in taken), key=lambda r: (-r[f"score_{b}"], r.pair_id))[: quotas[b]]
        for k, r in enumerate(free, 1):
            taken.add(r.pair_id)
            want.append((len(want) + 1, r.pair_id, b, k, r[f"score_{b}"]))
    got = selection.bucketed(df, budget).select("selection_rank", "pair_id", "selection_bucket", "selection_bucket_rank", "selection_score")
    assert sorted(map(tuple, got.collect())) == want


def test_quotas():
    assert selection.bucket_quotas(128) == dict.fromkeys(BUCKETS, 32)
    assert list(selection.bucket_quotas(10).values()) == [3, 3, 2, 2]
    assert selection.bucket_quotas(4, {b: 0 for b in BUCKETS[1:]})["easy_match_candidate"] == 4
    for bad in ({"odd": 1}, {"easy_match_candidate": -1}, dict.fromkeys(BUCKETS, 0)):
        with pytest.raises(ValueError):
            selection.bucket_quotas(4, bad)
    assert sum(selection.bucket_quotas(7, {"easy_match_candidate": 0.9}).values()) == 7


def test_too_few_rows(spark):
    for f in (selection.top_k, selection.prefix):
        with pytest.raises(ValueError, match="Need at least 5 rows, found 3"):
            f(scored(spark, 3), 5)
    with pytest.raises(ValueError, match="Need at least"):
        selection.bucketed(scored(spark, 3), 5)


def test_balanced_samples(spark):
    df = spark.createDataFrame([(f"p{i}", i % 3 == 0) for i in range(90)], "pair_id string, label boolean")
    rows = selection.balanced_samples(df, (4, 16)).collect()
    small, large = ({r.pair_id for r in rows if r.budget == b} for b in (4, 16))
    assert small < large and len(small) == 4 and sum(r.label for r in rows if r.budget == 16) == 8
    assert sorted(r.place for r in rows if r.budget == 16) == list(range(1, 17))
    assert {tuple(r) for r in selection.balanced_samples(df, (4, 16)).collect()} == {tuple(r) for r in rows}
    for bad in ((0,), (3,), (100,)):
        with pytest.raises(ValueError):
            selection.balanced_samples(df, bad)


def test_fixed_sample_and_caps(spark):
    df = spark.createDataFrame([(f"p{i}", i, "ab"[i % 2]) for i in range(50)], "pair_id string, ordinal int, g string")
    some = [r.ordinal for r in selection.fixed_sample(df, 9).collect()]
    assert len(some) == 9 and some == sorted(some)
    assert selection.fixed_sample(df, None).count() == 50
    with pytest.raises(ValueError):
        selection.fixed_sample(df, 0)
    assert sorted(r.ordinal for r in selection.cap_per_group(df, "g", 2).collect()) == [0, 1, 2, 3]


CACHE = "pair_id string, dataset string, split string, teacher_model string, prompt_version string, created_at string, raw_answer string, label string, valid boolean, gold_label string, selection_rank int, selection_score double, selection_seed int, selection_strategy string, selection_uses_gold_label boolean, selection_bucket string, selection_bucket_rank int, selection_bucket_quota int, input_tokens long, output_tokens long, estimated_cost_usd double, mode string, ordinal int"


def cache(spark, *rows):
    base = dict(pair_id="a", dataset="d", split="train", teacher_model="m", prompt_version="v", created_at="t", raw_answer="match", label="match", valid=True, gold_label="match", input_tokens=1, output_tokens=1, estimated_cost_usd=0.5, mode="teacher_label", ordinal=0)
    names = [c.split()[0] for c in CACHE.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], CACHE)


def test_cache_rules(spark):
    bad = [{"pair_id": ""}, {"selection_rank": 0}, {"input_tokens": -1}, {"label": None}, {"valid": False}, {"mode": "x"}, {"gold_label": "y"}, {"estimated_cost_usd": -0.1}, {"created_at": None}]
    good = labels.eligible(cache(spark, {}, *bad), "v", "m").count()
    assert good == 1
    assert labels.eligible(cache(spark, {}), "other", "m").count() == 0


def test_last_first_and_targets(spark):
    c = cache(spark, {"ordinal": 1}, {"ordinal": 3, "valid": False, "label": None}, {"pair_id": "b", "ordinal": 2}).withColumn("mode", F.lit("direct_prediction"))
    pairs = spark.createDataFrame([("a", "", "ta", 1, "s", 5), ("a", "x", "later", 2, "s", 5), ("c", "train", "tc", 3, "s", 5)], "pair_id string, split string, input_text string, ordinal int, selection_strategy string, selection_rank int")
    assert [(r.pair_id, r.ordinal, r.valid) for r in labels.latest_direct(c, pairs, "v", "m").collect()] == [("a", 3, False)]
    out = labels.teacher_targets(pairs, cache(spark, {"selection_rank": None, "selection_score": 0.0}), "llm_random").collect()
    assert [(r.pair_id, r.split, r.input_text, r.target_text, r.selection_rank, r.selection_score, r.selection_strategy) for r in out] == [("a", "train", "ta", "match", 5, 0.0, "s")]
    assert labels.target_counters(pairs, cache(spark, {})).first().asDict() == {"written": 1, "missing": 1, "duplicate_pair_ids": 1, "valid_labels": 1}
    with pytest.raises(ValueError, match="Duplicate valid teacher-label rows"):
        labels.teacher_targets(pairs, cache(spark, {}, {}), "llm_random")


def test_labeller_adapter(spark):
    def answer(prompt):
        if "pair_id: bad" in prompt:
            raise RuntimeError("down")
        assert "label:" in prompt and "gold" not in prompt
        return labels.Answer("match" if "equal-one" in prompt else "who knows", 7, 1, 0.25)

    pairs = spark.createDataFrame([("a", "equal-one", "train"), ("b", "differ", "train"), ("bad", "x", "train")], "pair_id string, input_text string, split string")
    out = {r.pair_id: r for r in labels.cache_rows(pairs, labels.ask(pairs, answer), "teacher_label", "v1", "m").collect()}
    assert (out["a"].label, out["a"].valid, out["a"].estimated_cost_usd, out["a"].error) == ("match", True, 0.25, None)
    assert (out["b"].label, out["b"].valid, out["b"].error) == (None, False, "unparsable answer: who knows")
    assert out["bad"].error == "RuntimeError: down" and not out["bad"].valid
    assert out["a"].created_at[10] == "T" and out["a"].created_at.endswith("+00:00")


def test_published_confusion_matrix(spark):
    df = spark.sql("SELECT 438L tp, 65L fp, 1935L tn, 62L fn").select(*[v.alias(k) for k, v in metrics.metrics_of(*map(F.col, ("tp", "fp", "tn", "fn"))).items()])
    r = df.first()
    assert (round(r.same_f1, 4), round(r.macro_f1, 4), r.accuracy) == (0.8734, 0.9208, 0.9492)


def test_null_predictions_and_empty_classes(spark):
    df = spark.createDataFrame([(1, True), (None, True), (0, False)], "prediction int, label boolean")
    r = metrics.prediction_metrics(df).first()
    assert (r.tp, r.fn, r.tn, r.invalid_predictions, r.invalid_output_rate) == (1, 1, 1, 1, pytest.approx(1 / 3))
    none = spark.sql("SELECT 0L a").select(*[v.alias(k) for k, v in metrics.metrics_of(*[F.col("a")] * 4).items()]).first()
    assert none.same_f1 == none.macro_f1 == none.accuracy == 0.0


def test_threshold(spark):
    scores = lambda rows: spark.createDataFrame(rows, "match_probability double, label boolean")
    best = metrics.best_threshold(scores([(0.1, False), (0.2, False), (0.3, True), (0.4, True)])).first()
    assert 0.2 < best.decision_threshold <= 0.3 and best.macro_f1 == 1.0
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 12) / 16, rnd.random() < 0.4) for _ in range(60)]
    u = sorted({p for p, _ in rows})
    keys = []
    for t in sorted({0.0, 0.5, 1.0, *u, *[(a + b) / 2 for a, b in zip(u, u[1:])]}):
        tp, fp = sum(p >= t and y for p, y in rows), sum(p >= t and not y for p, y in rows)
        fn, tn = sum(y for _, y in rows) - tp, sum(not y for _, y in rows) - fp
        f = lambda a, b, c: 2 * (a / (a + b)) * (a / (a + c)) / (a / (a + b) + a / (a + c)) if a else 0.0
        keys.append((-(f(tp, fp, fn) + f(tn, fn, fp)) / 2, -f(tp, fp, fn), -(tp + tn) / len(rows), abs(t - 0.5), t))
    assert metrics.best_threshold(scores(rows)).first().decision_threshold == min(keys)[-1]
    with pytest.raises(ValueError, match="empty validation set"):
        metrics.best_threshold(scores([]))


def test_losses_do_not_depend_on_grouping(spark):
    df = spark.createDataFrame([(0.5, 4), (1.0, 2), (0.25, 8)], "loss double, label_tokens long")
    assert metrics.weighted_loss(df).first().validation_loss == (2 + 2 + 2) / 14
    with pytest.raises(Exception, match="non-finite"):
        metrics.weighted_loss(spark.createDataFrame([(float("nan"), 1)], "loss double, label_tokens long")).collect()


def test_summary(spark):
    c = cache(spark, {"estimated_cost_usd": 0.1}, {"estimated_cost_usd": 0.2, "valid": False, "label": None}, {"pair_id": "b", "estimated_cost_usd": 0.3, "output_tokens": None})
    r = summary.cache_summary(c).first()
    assert r.duplicate_pair_ids == ["a"] and r.duplicate_extra_rows == 1 and r.estimated_total_cost_usd == pytest.approx(0.6) and r.estimated_cost_per_valid_label_usd == pytest.approx(0.3)
    assert r.label_distribution == {"match": 2} and r.teacher_models == ["m"] and r.invalid_rate == pytest.approx(1 / 3) and r.selection_bucket_distribution == {}
    empty = summary.cache_summary(cache(spark, {}).limit(0)).first()
    assert (empty.rows, empty.invalid_rate, empty.duplicate_pair_ids) == (0, 0.0, [])
    with pytest.raises(ValueError, match="Expected one"):
        summary.single_value(spark.createDataFrame([("a",), ("b",), (None,)], "x string"), "x")
    assert summary.single_value(spark.createDataFrame([(None,)], "x string"), "x", "d") == "d"


def test_costs(spark):
    students = lambda **k: spark.createDataFrame([("s", k.get("teacher"), "wall", k.get("train", 3600.0), 0.36)], "variant string, teacher_label_cost_usd double, training_time_scope string, training_wall_seconds double, student_inference_seconds_per_pair double")
    price = lambda rate: spark.createDataFrame([("p", "USD", rate)], "scenario string, currency string, usd_per_gpu_hour double")
    direct = lambda n: spark.createDataFrame([(1.0, n)], "total_cost_usd double, evaluated_pairs long")
    r = cost.cost_scenarios(students(teacher=0.5), price(1.0), direct(1000)).first()
    assert r.break_even_queries == 1667 and r.student_upfront_cost_usd == 1.5 and r.savings_at_comparison_scale_usd == pytest.approx(1 - 1.6)
    assert cost.cost_scenarios(students(), price(100.0), direct(1000)).first().break_even_queries is None
    for s, p, d in ((students(train=-1.0), price(1.0), direct(9)), (students(), price(float("nan")), direct(9)), (students(), price(1.0), direct(0)), (students(teacher=float("inf")), price(1.0), direct(9)), (students(train=None), price(1.0), direct(9))):
        with pytest.raises(Exception, match="must be"):
            cost.cost_scenarios(s, p, d).collect()
    with pytest.raises(Exception, match="bad estimated_cost_usd"):
        summary.teacher_cost(spark.createDataFrame([("a", "llm_teacher", None)], "pair_id string, label_source string, estimated_cost_usd double")).collect()


def test_contracts(spark, tmp_path):
    assert contracts.parse_fields(["a=1", "b=x=y", "c="]) == {"a": "1", "b": "x=y", "c": ""}
    for bad in (["=1"], ["a"], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            contracts.parse_fields(bad)
    (tmp_path / "f.txt").write_text("abc")
    made = contracts.contract(spark, {"budget": "128"}, {"targets": str(tmp_path / "f.txt")})
    (tmp_path / "f.txt").write_text("abd")
    again = contracts.contract(spark, {"budget": "64"}, {"targets": str(tmp_path / "f.txt")})
    # The first contract is read lazily, so it is compared as it was written down.
    first = spark.createDataFrame([("fields", "budget", "128"), ("files", "targets", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("schema_version", "schema_version", "1")], made.schema)
    assert sorted((r.section, r.key) for r in contracts.difference(first, again).collect()) == [("fields", "budget"), ("files", "targets")]
    assert contracts.difference(first, first).count() == 0


def test_accumulation_groups_on_a_whole_table(spark):
    n = 30_001
    steps = spark.range(n).select((F.col("id") * 7 % n * 3 + 1).alias("step")).repartition(5)
    out = labels.accumulation_groups(steps, 7)
    want = [(3 * i + 1, i // 7, 7 if i // 7 < n // 7 else n % 7) for i in range(n)]
    assert sorted(map(tuple, out.select("step", "group", "group_rows").collect())) == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert labels.accumulation_groups(steps.limit(0), 7).collect() == []


@pytest.mark.parametrize("patience", [5, 20_000])
def test_early_stop_on_a_whole_table(spark, patience):
    n = 12_001
    f1 = [((i * 37 % 11 + i // 3000) / 16, (i * 53 % 7) / 8) for i in range(n)]
    epochs = spark.createDataFrame([(i, *x) for i, x in enumerate(f1)], "epoch long, macro_f1 double, same_f1 double").repartition(5)
    out = metrics.early_stop(epochs, patience)
    want, best, last = [], None, 0
    for i, x in enumerate(f1):
        better = best is None or x > best
        best, last = (x, i) if better else (best, last)
        want.append((i, better, i - last, i - last >= patience))
        if i - last >= patience:
            break
    assert sorted(map(tuple, out.select("epoch", "improved", "waited", "stopped").collect())) == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()

def test_sweep_over_many_probabilities(spark):
    """More distinct probabilities than a range holds, neighbours without a number between them, and nulls."""
    draw = random.Random(7)
    rows = [(draw.random(), draw.random() < 0.4) for _ in range(12_000)] + [(0.3, True), (math.nextafter(0.3, 1), False), (0.5, True), (None, True), (0.0, False)]
    df = spark.createDataFrame(rows, "match_probability double, label boolean")
    got = {r.decision_threshold: r for r in metrics.threshold_sweep(df).collect()}
    known = sorted({p for p, _ in rows if p is not None})
    want = {0.0, 0.5, 1.0, *known, *((x + y) / 2 for x, y in zip(known, known[1:]))}
    assert got.keys() == want
    for t in draw.sample(sorted(want), 40) + [0.0, 0.3, 0.5, 1.0]:
        hit = [p is not None and p >= t for p, _ in rows]
        right = sum(h == y for h, (_, y) in zip(hit, rows))
        tp, guessed, real = sum(h and y for h, (_, y) in zip(hit, rows)), sum(hit), sum(y for _, y in rows)
        assert math.isclose(got[t].accuracy, right / len(rows))
        assert math.isclose(got[t].same_f1, 2 * tp / (guessed + real))


def test_composition_of_overlaps_and_hard_negatives(spark):
    rows = [("a", True, 0.25, 0, 0.0), ("a", False, 0.5, 2, 1.0), ("a", False, 0.333333, 0, 1.0), ("b", False, 0.0, 1, 0.0), ("c", True, None, 0, 0.0)]
    df = spark.createDataFrame(rows, "strategy string, label boolean, title_similarity double, missing_key_fields int, hard_negative_hint double")
    got = {r.strategy: (r.n, r.mean_overlap, r.missing_rate, r.hard_negative_rate) for r in summary.composition(df.withColumn("label", F.col("label").cast("int")), "strategy").collect()}
    assert got == {"a": (3, 1083333 / 3 / 1e6, 1 / 3, 2 / 3), "b": (1, 0.0, 1.0, 0.0), "c": (1, None, 0.0, 0.0)}
