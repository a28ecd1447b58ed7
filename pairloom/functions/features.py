"""Attribute features of a record pair, and the scores of the selection buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import attribute, jaccard, model_tokens, price, round6, strip, word_tokens

#: Buckets in their order of choice.
BUCKETS = ("easy_match_candidate", "hard_match_candidate", "easy_non_match_candidate", "hard_negative_candidate")
KEY_FIELDS = ("title", "brand", "description")
HYBRID_ONLY = ("hard_negative_hint", "active_hybrid_score")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _weighted(*parts: tuple[float, Column]) -> Column:
    """The sum of weight times value, from left to right (so that the last digits are defined)."""
    total = None
    for weight, value in parts:
        total = F.lit(weight) * value if total is None else total + F.lit(weight) * value
    return total


def _unsure(similarity: Column) -> Column:
    return 1.0 - F.least(F.abs(similarity - 0.5) * 2.0, F.lit(1.0))


def record_fields(record: Column, side: str) -> dict[str, Column]:
    """What the features need of one record; ``side`` ends the names."""
    low = lambda name: F.lower(strip(attribute(record, name)))
    return {
        f"__t{side}": word_tokens(attribute(record, "title")),
        f"__d{side}": word_tokens(attribute(record, "description")),
        f"__m{side}": model_tokens(attribute(record, "title")),
        f"__b{side}": low("brand"),
        f"__c{side}": low("priceCurrency"),
        f"__p{side}": price(attribute(record, "price")),
        f"__n{side}": sum((F.when(attribute(record, f) == "", 1).otherwise(0) for f in KEY_FIELDS), F.lit(0)),
    }


def text_signals() -> dict[str, Column]:
    """Similarities and conflicts of title, description and brand, from the fields of two records."""
    c = F.col
    model = jaccard(c("__ma"), c("__mb"))
    return {
        "__title": jaccard(c("__ta"), c("__tb")),
        "__desc": jaccard(c("__da"), c("__db")),
        "__model": model,
        "brand_agreement": _flag((c("__ba") != "") & (c("__ba") == c("__bb"))),
        "brand_conflict": _flag((c("__ba") != "") & (c("__bb") != "") & (c("__ba") != c("__bb"))),
        "missing_key_fields": (c("__na") + c("__nb")).cast("int"),
        "model_conflict": _flag((F.size("__ma") > 0) & (F.size("__mb") > 0) & (model == 0.0)),
    }


def offer_signals() -> dict[str, Column]:
    """Price gap and conflict of currencies, from the fields of two records."""
    c = F.col
    ratio = (c("__pa") + 1e-9) / (c("__pb") + 1e-9)
    gap = F.when((c("__pa") != 0) & (c("__pb") != 0) & (F.greatest("__pa", "__pb") > 0) & (ratio > 0), F.least(F.abs(F.log(ratio)) / 5.0, F.lit(1.0)))
    return {"currency_conflict": _flag((c("__ca") != "") & (c("__cb") != "") & (c("__ca") != c("__cb"))), "__gap": F.coalesce(gap, F.lit(0.0))}


def scored_signals() -> dict[str, Column]:
    """The rounded features, from the signals and hard_negative_hint."""
    c = F.col
    surface = _weighted((0.70, c("__title")), (0.30, c("__desc")))
    positive = _weighted((0.45, c("__title")), (0.20, c("__desc")), (0.20, c("__model")), (0.15, c("brand_agreement")))
    conflict = _weighted((0.40, c("brand_conflict")), (0.25, c("model_conflict")), (0.20, c("__gap")), (0.15, c("currency_conflict")))
    hybrid = _weighted(
        (0.35, _unsure(c("__title"))),
        (0.15, _unsure(c("__desc"))),
        (0.15, c("__model")),
        (0.10, c("brand_agreement")),
        (0.10, c("brand_conflict")),
        (0.05, c("currency_conflict")),
        (0.05, c("__gap")),
        (0.03, F.least(c("missing_key_fields") / 4.0, F.lit(1.0))),
        (0.02, c("hard_negative_hint")),
    )
    return {
        "title_similarity": round6(c("__title")),
        "description_similarity": round6(c("__desc")),
        "model_overlap": round6(c("__model")),
        "price_ratio_gap": round6(c("__gap")),
        "surface_similarity": round6(surface),
        "positive_evidence": round6(positive),
        "conflict_evidence": round6(conflict),
        "active_hybrid_score": round6(hybrid),
    }


def with_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (record_a, record_b, metadata) with the features of the hybrid score.

    Tokens are computed once. A price gap needs two prices of equal sign; without
    them it is 0. Rounded values have six decimals.
    """
    tokens = pairs.withColumns(record_fields(F.col("record_a"), "a") | record_fields(F.col("record_b"), "b"))
    hint = {"hard_negative_hint": _flag(F.coalesce(F.col("metadata.is_hard_negative"), F.lit(False)))}
    raw = tokens.withColumns(text_signals() | offer_signals() | hint)
    done = raw.withColumns(scored_signals())
    return done.drop(*[x for x in done.columns if x.startswith("__")])


FEATURES = (
    "title_similarity",
    "description_similarity",
    "model_overlap",
    "brand_agreement",
    "brand_conflict",
    "model_conflict",
    "currency_conflict",
    "price_ratio_gap",
    "missing_key_fields",
    "hard_negative_hint",
    "surface_similarity",
    "positive_evidence",
    "conflict_evidence",
    "active_hybrid_score",
)


def bucket_scores() -> dict[str, Column]:
    """The score of each bucket, from the rounded features."""
    c = F.col
    missing = F.least(c("missing_key_fields") / 4.0, F.lit(1.0))
    low, unsure = 1.0 - c("surface_similarity"), _unsure(c("surface_similarity"))
    no_signal = _flag((c("brand_agreement") == 0) & (c("brand_conflict") == 0))
    agreed = 1.0 - c("conflict_evidence")
    scores = {
        "easy_match_candidate": ((0.45, c("surface_similarity")), (0.20, c("model_overlap")), (0.20, c("brand_agreement")), (0.10, agreed), (0.05, 1.0 - missing)),
        "hard_match_candidate": ((0.35, c("positive_evidence")), (0.25, unsure), (0.20, low), (0.10, missing), (0.10, agreed)),
        "easy_non_match_candidate": (
            (0.45, low),
            (0.20, 1.0 - c("model_overlap")),
            (0.15, no_signal),
            (0.10, c("brand_conflict")),
            (0.05, c("currency_conflict")),
            (0.05, c("price_ratio_gap")),
        ),
        "hard_negative_candidate": ((0.35, c("surface_similarity")), (0.20, c("positive_evidence")), (0.20, c("conflict_evidence")), (0.15, c("model_conflict")), (0.10, unsure)),
    }
    return {name: round6(_weighted(*scores[name])) for name in BUCKETS}


def with_bucket_scores(featured: DataFrame) -> DataFrame:
    """With a column score_<bucket> for each bucket; the hints that only the hybrid score knows go."""
    return featured.withColumns({f"score_{k}": v for k, v in bucket_scores().items()}).drop(*HYBRID_ONLY)
