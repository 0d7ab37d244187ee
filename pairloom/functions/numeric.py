"""Numeric, set and statistical functions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def jaccard(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` is its value for two empty sets (None: null)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty).cast("double"))


def conflict(a: Column, b: Column, mode: str = "disjoint") -> Column:
    """Whether two sets, both with members, disagree: no common member, or (``unequal``) not the same members."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    if mode == "disjoint":
        return both & ~F.arrays_overlap(a, b)
    return both & (F.size(F.array_intersect(a, b)) < F.size(F.array_union(a, b)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    """Stable on either side of zero."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1.0 - q))


def entropy(p: Column) -> Column:
    """Binary entropy in bits, rounded to 14 places so that mirrored values tie."""
    q = clip(p, 1e-12, 1 - 1e-12)
    return F.round(-(q * F.log(q) + (1.0 - q) * F.log(1.0 - q)) / math.log(2), 14)


def log_loss(y: Column, p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))


def wilson(successes: Column, trials: Column, upper: bool = False, z: float = Z95) -> Column:
    """Bound of the Wilson interval; without trials 1 above and 0 below."""
    n, p = trials.cast("double"), successes / trials
    centre, half = p + z * z / (2 * n), z * F.sqrt((p * (1.0 - p) + z * z / (4 * n)) / n)
    bound = (centre + half if upper else centre - half) / (1 + z * z / n)
    return F.when(trials > 0, clip(bound, 0.0, 1.0)).otherwise(F.lit(1.0 if upper else 0.0))


def negative_weight(positives: Column, negatives: Column, prevalence: Column) -> Column:
    """Weight of each negative that brings the share of positives to ``prevalence``."""
    return F.when(negatives > 0, positives * (1.0 - prevalence) / (prevalence * negatives))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
