"""Binary classification metrics, decision thresholds and training curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.ranges import in_ranges


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def metrics_of(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """All measures of a confusion matrix; a measure without denominator is 0.0."""

    def one(hit: Column, false_alarm: Column, miss: Column) -> tuple[Column, Column, Column]:
        p, r = _share(hit, hit + false_alarm), _share(hit, hit + miss)
        return p, r, _share(2 * p * r, p + r)

    same, other = one(tp, fp, fn), one(tn, fn, fp)
    out = {f"{side}_{name}": v for side, vs in (("same", same), ("different", other)) for name, v in zip(("precision", "recall", "f1"), vs)}
    out |= {f"macro_{name}": (a + b) / 2 for name, a, b in zip(("precision", "recall", "f1"), same, other)}
    return out | {"accuracy": _share(tp + tn, tp + fp + tn + fn), "tp": tp, "fp": fp, "tn": tn, "fn": fn}


#: Thresholds that are candidates whatever the probabilities are.
FIXED_CANDIDATES = (0.0, 0.5, 1.0)


def _confusion(rows: DataFrame, predicted: Column, label: Column, by: Sequence[str], n: Column | None = None) -> DataFrame:
    """With ``n`` a row counts as so many."""
    cells = {"tp": predicted & label, "fp": predicted & ~label, "tn": ~predicted & ~label, "fn": ~predicted & label}
    if n is not None:
        return rows.groupBy(*by).agg(*[F.sum(F.when(v, n).otherwise(0)).alias(k) for k, v in cells.items()], F.coalesce(F.sum(n), F.lit(0)).alias("total"))
    return rows.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in cells.items()], F.count("*").alias("total"))


def _expanded(counted: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    c = F.col
    return counted.select(*by, *[v.alias(k) for k, v in metrics_of(c("tp"), c("fp"), c("tn"), c("fn")).items()], *more)


def prediction_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics where an unreadable prediction counts as non-match. prediction: 0, 1 or null; label: boolean."""
    counted = _confusion(predictions, F.coalesce(F.col("prediction") == 1, F.lit(False)), F.col("label"), by)
    valid = predictions.groupBy(*by).agg(F.count("prediction").alias("valid_predictions"))
    joined = counted.join(valid, list(by)) if by else counted.withColumn("one", F.lit(1)).join(valid.withColumn("one", F.lit(1)), "one")
    total, n_valid = F.col("total"), F.col("valid_predictions")
    return _expanded(
        joined, by, total.alias("total_predictions"), n_valid, (total - n_valid).alias("invalid_predictions"), _share(total - n_valid, total).alias("invalid_output_rate")
    )


def direct_metrics(rows: DataFrame, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Metrics where invalid rows are left out: no row at all if none is valid. label, gold_label: cache spelling; n: a column that says how many rows a row is."""
    counted = _confusion(rows.filter("valid"), F.col("label") == "match", F.col("gold_label") == "match", by, F.col(n) if n else None)
    return _expanded(counted.filter("total > 0"), by)


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """Every candidate threshold with its metrics. scores: match_probability, label (boolean).

    Candidates are 0, 0.5, 1, the probabilities and the middles between neighbours; a
    row without probability is never predicted and makes no candidate. A candidate's
    confusion matrix follows from the counts at or above it, so no row is compared with
    a threshold. Windows see one range of the distinct probabilities; from the ranges
    above they need one row a range.
    """
    at = scores.groupBy(F.col("match_probability").alias("p")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    ranged, _ = in_ranges(at, "p")
    reached = [F.sum(F.when(F.col("p") >= t, F.col(v)).otherwise(0)).alias(f"{v}{i}") for i, t in enumerate(FIXED_CANDIDATES) for v in ("pos", "neg")]
    # MOST_RANGES rows at most go to the driver.
    tops = sorted((r.asDict() for r in ranged.groupBy("range").agg(F.min("p").alias("least"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *reached).collect()), key=lambda r: r["range"])
    carried, above, pos, neg = [], None, 0, 0
    for r in reversed(tops):
        carried.append((r["range"], above, pos, neg))
        above, pos, neg = r["least"], pos + r["pos"], neg + r["neg"]
    spark = scores.sparkSession
    kind = at.schema["p"].dataType.simpleString()
    both = ranged.join(F.broadcast(spark.createDataFrame(carried, f"range int, above {kind}, pos_above long, neg_above long")), "range")
    w = Window.partitionBy("range").orderBy("p")
    up = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumns({"tp": F.sum("pos").over(up) + F.col("pos_above"), "fp": F.sum("neg").over(up) + F.col("neg_above"), "next": F.coalesce(F.lead("p").over(w), "above")})
    own = F.struct(F.col("p").cast("double").alias("t"), "tp", "fp")
    # Between neighbours without a number in between there is no middle.
    middle = ((F.col("p") + F.col("next")) / 2.0).cast("double")
    between = F.when((middle > F.col("p")) & (middle < F.col("next")), F.struct(middle.alias("t"), (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp")))
    found = both.filter("p IS NOT NULL").select(F.inline(F.array_compact(F.array(own, between)))).filter(~F.col("t").isin(*FIXED_CANDIDATES))
    fixed = [(t, sum(r[f"pos{i}"] for r in tops), sum(r[f"neg{i}"] for r in tops)) for i, t in enumerate(FIXED_CANDIDATES)]
    sums = found.unionByName(spark.createDataFrame(fixed, "t double, tp long, fp long"))
    sums = sums.withColumns({"fn": F.lit(pos) - F.col("tp"), "tn": F.lit(neg) - F.col("fp")})
    return _expanded(sums, ["t"]).withColumnRenamed("t", "decision_threshold")


def best_threshold(scores: DataFrame) -> DataFrame:
    """The candidate of best macro F1, then match F1, accuracy, nearness to 0.5; the lowest if all tie."""
    if scores.isEmpty():
        raise ValueError("cannot select a decision threshold from an empty validation set")
    near = -F.abs(F.col("decision_threshold") - 0.5)
    return threshold_sweep(scores).orderBy(F.desc("macro_f1"), F.desc("same_f1"), F.desc("accuracy"), near.desc(), F.asc("decision_threshold")).limit(1)


def weighted_loss(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss weighted by label tokens; a loss that is no finite number is an error."""
    fine = F.when(F.isnan("loss") | (F.abs("loss") == float("inf")), F.raise_error(F.lit("non-finite loss")).cast("double")).otherwise(F.col("loss"))
    return batches.groupBy(*by).agg((F.sum(fine * F.col("label_tokens")) / F.sum("label_tokens")).alias("validation_loss"), F.avg("loss").alias("mean_loss"))


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """Epochs with best-so-far flags up to the stop. Better: higher (macro_f1, same_f1), one after the other.

    ``improved``: better than all before; ``waited``: epochs since; ``stopped``: the run ends here.
    Windows see one range of epochs; what they carry over from the ranges before is one row a range.
    """
    ranged, _ = in_ranges(epochs, "epoch")
    spark, w = epochs.sparkSession, Window.partitionBy("range").orderBy("epoch")
    key = F.struct("macro_f1", "same_f1")

    def carried(df: DataFrame, value: Column, kind: str) -> DataFrame:
        """The greatest value of all ranges before. MOST_RANGES rows at most go to the driver."""
        tops, best, rows = sorted((r["range"], r["top"]) for r in df.groupBy("range").agg(F.max(value).alias("top")).select("range", F.struct("top").alias("top")).collect()), None, []
        for r, (top,) in tops:
            rows.append((r, best))
            best = top if best is None or (top is not None and top > best) else best
        return F.broadcast(spark.createDataFrame(rows, f"range int, before {kind}"))

    types = {f.name: f.dataType.simpleString() for f in epochs.schema.fields}
    before = carried(ranged, key, f"struct<macro_f1: {types['macro_f1']}, same_f1: {types['same_f1']}>")
    best = F.greatest("before", F.max(key).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = ranged.join(before, "range").withColumn("best", best).withColumn("improved", F.col("best").isNull() | (key > F.col("best"))).drop("before", "best")
    at = F.when(F.col("improved"), F.col("epoch"))
    last = F.coalesce(F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before")
    out = out.join(carried(out, at, types["epoch"]), "range").withColumn("waited", F.col("epoch") - last).drop("before", "range")
    end = out.filter(F.col("waited") >= patience).agg(F.min("epoch")).first()[0]
    return (out if end is None else out.filter(F.col("epoch") <= end)).withColumn("stopped", F.col("epoch").eqNullSafe(F.lit(end)))


def token_audit(rows: DataFrame, n_tokens: Column, limit: int, examples: int = 20) -> DataFrame:
    """One row: rows, the longest, how many are over the limit, and the first pair_ids of those."""
    lengths = rows.select("pair_id", n_tokens.alias("n_tokens"))
    return token_audit_of(lengths.withColumn("n", F.lit(1).cast("long")), lengths.filter(F.col("n_tokens") > limit), limit, examples)


def token_audit_of(lengths: DataFrame, over: DataFrame, limit: int, examples: int = 20) -> DataFrame:
    """``token_audit`` of how many rows (n) have how many tokens (n_tokens), and of the pair_ids over the limit, or the first of them."""
    over = over.select("pair_id").orderBy("pair_id").limit(examples).agg(F.array_sort(F.collect_list("pair_id")).alias("examples"))
    rows, long = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n"))), F.lit(0))
    counted = lengths.agg(rows.alias("rows"), F.max("n_tokens").alias("max_tokens"), long.alias("overflow"))
    return counted.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")
