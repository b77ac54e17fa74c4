"""Scores, confidences and small statistics as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    """greatest() and least() skip nulls, so null must be kept by hand."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def or_default(c: Column, default: float) -> Column:
    """0 counts as absent, as null does."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def binary_score(probability: Column, logit: Column, score: Column) -> Column:
    return clamp01(F.coalesce(probability, sigmoid(logit), score))


def unit_from_regression(v: Column) -> Column:
    """Tried in this order: already a unit, a value about -1..1, one on the 1..9 scale, else a logit."""
    return F.when(v.between(0, 1), v).when(v.between(-1.05, 1.05), clamp01((v + 1) / 2)).when((v > 1) & (v <= 9.05), clamp01((v - 1) / 8)).otherwise(sigmoid(v))


def unit_from_score(v: Column) -> Column:
    return F.when(v.between(0, 1), v).otherwise(sigmoid(v))


#: Offset, width and weight of what the energy estimate is made of.
ENERGY_PARTS = {"loudness": (60.0, 60.0, 0.45), "dynamic_complexity": (0.0, 15.0, 0.35), "onset_rate": (0.0, 8.0, 0.20)}


def energy_proxy(loudness: Column, dynamic: Column, onset: Column) -> tuple[Column, Column]:
    """(value, confidence): weighted parts renormalised over those present; null without any."""
    weighted, weights, present = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, (offset, width, weight) in zip((loudness, dynamic, onset), ENERGY_PARTS.values(), strict=True):
        weighted = weighted + F.coalesce(clamp01((c + offset) / width) * weight, F.lit(0.0))
        weights = weights + F.when(c.isNotNull(), weight).otherwise(0.0)
        present = present + c.isNotNull().cast("int")
    return F.when(present > 0, clamp01(weighted / weights)), F.when(present > 0, 0.5 + 0.5 * present / 3)


#: The fields of a feature row and the range in which each is valid (None: any).
FIELD_RANGES: Mapping[str, tuple[float, float] | None] = {
    "bpm": (0, float("inf")), "energy": (0, 1), "danceability": (0, 1), "valence": (0, 1), "acousticness": (0, 1), "instrumentalness": (0, 1), "liveness": (0, 1),
    "speechiness": (0, 1), "loudness": None, "key": (0, 11), "mode": (0, 1), "time_signature": (0, float("inf")), "duration_ms": (0, float("inf")),
}


def valid_field(name: str, c: Column) -> Column:
    span = FIELD_RANGES[name]
    return F.when(c.isNotNull() if span is None else (c >= span[0]) & (c <= span[1]), c)


def row_confidence(fields: Mapping[str, Column], confidence: Column) -> tuple[Column, Column]:
    """(mean confidence, status): success if all fields are valid, partial if some are, else failed."""
    valid = F.lit(0)
    for name, c in fields.items():
        valid = valid + valid_field(name, c).isNotNull().cast("int")
    return F.when(valid > 0, confidence), F.when(valid == len(fields), "success").when(valid > 0, "partial").otherwise("failed")


def match_confidence(kind: Column) -> Column:
    return F.when(kind == "isrc", 1.0).when(kind == "id", 0.9).otherwise(0.5)


#: How far a segment's origin is trusted.
ORIGIN_WEIGHTS = {"representative": 0.95, "three_segments": 1.0, "preview": 0.70}


def origin_weight(origin: Column) -> Column:
    found = F.lit(1.0)
    for name, weight in ORIGIN_WEIGHTS.items():
        found = F.when(origin == name, weight).otherwise(found)
    return found


def min_max(v: Column, low: Column, high: Column) -> Column:
    """Scaled where both bounds are known, then clamped."""
    return clamp01(F.when(low.isNotNull() & high.isNotNull() & (high > low), (v - low) / (high - low)).otherwise(v))


def p95(values: Column) -> Column:
    """Nearest rank below: the element at floor(.95 n) - 1 (0 at least) of the sorted array; 0 if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.floor(n * 0.95).cast("int")))).otherwise(0.0)
