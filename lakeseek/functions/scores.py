"""Fusion, normalisation and confidence of scores, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
ALPHA = 0.7


@dataclass(frozen=True)
class Thresholds:
    """Absolute bands, absolute levels and shares of the top score."""

    strong: float = 0.50
    expected: float = 0.35
    weak: float = 0.25
    high: float = 0.50
    medium: float = 0.40
    low: float = 0.30
    high_share: float = 0.90
    medium_share: float = 0.75
    low_share: float = 0.50


DEFAULT = Thresholds()


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion: a missing rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0).cast("double") / (F.lit(k) + r), F.lit(0.0))
    return out


def alpha_fusion(semantic: Column, fulltext: Column, alpha: float = ALPHA) -> Column:
    return F.lit(alpha) * F.coalesce(semantic, F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce(fulltext, F.lit(0.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Position in the range; a range of one value gives 0."""
    return (x - low) / F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)


def band(score: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(score >= t.strong, "strong").when(score >= t.expected, "expected_range").when(score >= t.weak, "weak").otherwise("very_weak")


def absolute_level(score: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(score >= t.high, "high").when(score >= t.medium, "medium").when(score >= t.low, "low").otherwise("very_low")


def relative_level(score: Column, top: Column, t: Thresholds = DEFAULT) -> Column:
    share = score / F.when(top > 0, top)
    return F.when(top <= 0, "very_low").when(share >= t.high_share, "high").when(share >= t.medium_share, "medium").when(share >= t.low_share, "low").otherwise("very_low")


def percent(score: Column, top: Column) -> Column:
    return F.when(top > 0, score / F.when(top > 0, top) * 100).otherwise(0.0)


def hybrid_level(score: Column, top: Column, rank: Column, t: Thresholds = DEFAULT) -> Column:
    """Level from the share of the top score and the absolute band, the first rule that holds."""
    pct, b = percent(score, top), band(score, t)
    near = pct >= 100 * t.high_share
    return (
        F.when(top <= 0, "very_low")
        .when(near & b.isin("strong", "expected_range"), "high")
        .when(near & (b == "weak"), "medium")
        .when(near, F.when(rank == 1, "medium").otherwise("low"))
        .when((pct >= 100 * t.medium_share) | (b == "expected_range"), "medium")
        .when((pct >= 100 * t.low_share) | (b == "weak"), "low")
        .otherwise("very_low")
    )


def signal(score: Column, top: Column, rank: Column, t: Thresholds = DEFAULT) -> Column:
    """What the score says beside the best one, in words."""
    pct, b = percent(score, top), band(score, t)
    good = b.isin("strong", "expected_range")
    # The signal words.
    first = (
        F.when(b == "strong", "top_result_strong_match")
        .when(b == "expected_range", "top_result_in_typical_range")
        .when(b == "weak", "top_result_weak_absolute")
        .otherwise("top_result_very_weak_but_best_available")
    )
    return (
        F.when(top <= 0, "no_valid_top_score")
        .when(rank == 1, first)
        .when(pct >= 90, "close_to_top")
        .when(pct >= 75, F.when(good, "good_alternative").otherwise("close_to_top_but_weak_absolute"))
        .when(pct >= 50, "moderate_relevance")
        .otherwise("score_drop_from_top")
    )


def level(score: Column, top: Column, rank: Column, t: Thresholds = DEFAULT) -> Column:
    """The level shown: beside the top score if there is a positive one, else absolute."""
    return F.when(top > 0, hybrid_level(score, top, rank, t)).otherwise(absolute_level(score, t))
