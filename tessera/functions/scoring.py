"""Numeric scoring functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or(x: Column, other: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), other).otherwise(x)


def recency(age_days: Column, half_life: float) -> Column:
    """0.5 ** (age / half life), 1 for ages of 0 and less."""
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def saturate(x: Column, scale: float) -> Column:
    """1 - exp(-x / scale), 0 for x <= 0."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(1 - F.exp(-x / scale))


def acceleration(w7: Column, w30: Column) -> Column:
    """(w7 / 7) / (w30 / 30); 10 if there is nothing in 30 days but something in 7."""
    return F.when(w30 > 0, (w7 / 7.0) / (w30 / 30.0)).when(w7 > 0, F.lit(10.0)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles over the shorter length; 0 for empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda e: e.cast("double") * e.cast("double"))))
    return F.when((n > 0) & (norm(x) * norm(y) > 0), dot / (norm(x) * norm(y))).otherwise(F.lit(0.0))


def weighted_score(values: list[Column], weights: list[float], diversity: Column, positive: float = 0.3, override: float = 0.4) -> tuple[Column, Column, Column]:
    """(score cut to 0..1, positive dimensions, converged flag) of normalised dimensions."""
    score = sum((v * w for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    count = sum((F.when((v > positive) & F.lit(w > 0), 1).otherwise(0) for v, w in zip(values, weights, strict=True)), F.lit(0))
    return score, count, ((count >= 2) & (diversity >= 2)) | (score >= override)


def exact_sum(x: Column) -> Column:
    """An aggregate that adds doubles as decimals of ten places: the same in whatever order the rows come."""
    return F.sum(x.cast("decimal(38,10)")).cast("double")
