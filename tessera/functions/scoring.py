"""Score expressions: fusion, decision functions, feature maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fused(weight: float, first: Column, second: Column) -> Column:
    return F.lit(weight) * first + F.lit(1.0 - weight) * second


def distance_to_similarity(distance: Column) -> Column:
    return F.lit(1.0) - F.lit(0.5) * distance


def log_ratio(a: Column, b: Column, signed: bool = False) -> Column:
    """ln(a / b) with both at least 1, absolute unless signed."""
    r = F.log(F.greatest(a, F.lit(1.0)) / F.greatest(b, F.lit(1.0)))
    return r if signed else F.abs(r)


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def z_score(x: Column, mean: Column, std: Column, floor: float = 1e-12) -> Column:
    """A deviation below the floor counts as 1."""
    return (x - mean) / F.when(std < floor, 1.0).otherwise(std)


def quadratic_features(score: Column, margin: Column) -> Column:
    return F.array(score, margin, score * score, margin * margin, score * margin)


def linear(weights: list[float], bias: float, features: list[Column]) -> Column:
    out = F.lit(bias)
    for w, f in zip(weights, features, strict=True):
        out = out + F.lit(w) * f
    return out
