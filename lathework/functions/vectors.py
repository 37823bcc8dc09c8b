"""Errors between two vectors, quantisation and crossings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def errors(reference: Column, candidate: Column) -> dict[str, Column]:
    """max_abs, mean_abs, relative_l2 (its denominator at least 1e-12), finite and same_shape.

    Vectors of unlike length have infinite errors.
    """
    same = F.size(reference) == F.size(candidate)
    a = F.transform(reference, lambda x: x.cast("double"))
    b = F.transform(candidate, lambda x: x.cast("double"))
    gap = F.zip_with(a, b, lambda x, y: x - y)
    far = F.lit(float("inf"))
    size = F.size(reference)
    norm = F.sqrt(_fold(F.transform(a, lambda x: x * x)))
    return {
        "max_abs": F.when(~same, far).otherwise(F.array_max(F.transform(gap, F.abs))),
        "mean_abs": F.when(~same, far).otherwise(F.try_divide(_fold(F.transform(gap, F.abs)), size)),
        "relative_l2": F.when(~same, far).otherwise(
            F.sqrt(_fold(F.transform(gap, lambda x: x * x))) / F.greatest(norm, F.lit(1e-12))
        ),
        "finite": F.forall(F.concat(a, b), lambda x: ~F.isnan(x) & (F.abs(x) < far)),
        "same_shape": same,
    }


def cosine(a: Column, b: Column) -> Column:
    dot = _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(
        _fold(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    )
    return F.try_divide(dot, norms)


def quantise(x: Column, scale: float, low: int = -128, high: int = 127) -> Column:
    """The value after rounding (halves to even) to steps of ``scale`` within the range."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(x / scale))) * scale


def error_state(reference: Column, candidate: Column) -> list[Column]:
    """Sums that merge across partitions: count, absolute, squared and reference squares, largest."""
    gap = candidate - reference
    return [
        F.count(gap).alias("n"),
        F.sum(F.abs(gap)).alias("abs_sum"),
        F.sum(gap * gap).alias("square_sum"),
        F.sum(reference * reference).alias("reference_sum"),
        F.max(F.abs(gap)).alias("max_abs"),
    ]


def quantisation_state(x: Column, scale: float) -> list[Column]:
    """Range, clips, relative error and cosine of quantised values, from mergeable sums."""
    q = quantise(x, scale)
    return [
        F.count(x).alias("n"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count_if(F.rint(x / scale) < -128).alias("clip_low"),
        F.count_if(F.rint(x / scale) > 127).alias("clip_high"),
        F.sqrt(F.try_divide(F.sum((q - x) * (q - x)), F.sum(x * x))).alias("relative_l2"),
        F.try_divide(F.sum(q * x), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(q * q))).alias("cosine"),
    ]


def crossings(reference: Column, candidate: Column, threshold: float) -> list[Column]:
    """How many values cross the threshold, each way."""
    return [
        F.count_if((reference < threshold) & (candidate >= threshold)).alias("up"),
        F.count_if((reference >= threshold) & (candidate < threshold)).alias("down"),
    ]
