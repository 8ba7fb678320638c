"""Column functions for statistics and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, empty: tuple[float, float] = (0.0, 0.0), z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the Wilson interval of a share; ``empty`` where n is 0."""
    p, d = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ends = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return tuple(F.when(n == 0, F.lit(e)).otherwise(x) for e, x in zip(empty, ends, strict=True))


def learning_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to the floor, which holds from ``total`` on."""
    along = (step - warmup) / max(1, total - warmup)
    cosine = floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(math.pi) * along))
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step >= total, F.lit(floor)).otherwise(cosine)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(50.0)))


def flops_per_token(params: Column, layers: Column, width: Column, context: Column) -> Column:
    """Six for each parameter, and attention's share."""
    return 6 * params + 12 * layers * width * context


def exponent_off(got: Column, want: Column) -> Column:
    """The power of ten by which two numbers differ, rounded half to even."""
    return F.when((got != 0) & (want != 0), F.bround(F.log10(F.abs(got / want))))


def number_correct(got: Column, want: Column, tolerance: Column) -> Column:
    return F.coalesce(F.abs(got - want) <= F.greatest(tolerance * F.abs(want), F.lit(1e-6)), F.lit(False))


def number_error(got: Column, want: Column, tolerance: Column, looping: Column) -> Column:
    """Why a numeric answer is wrong: the first reason that applies."""
    k = exponent_off(got, want)
    scaled = number_correct(got / F.pow(F.lit(10.0), k), want, F.greatest(tolerance, F.lit(0.01)))
    return (
        F.when(number_correct(got, want, tolerance), "correct")
        .when(got.isNull(), "no_number")
        .when((k != 0) & scaled, F.format_string("unit_error (off by 10^%d)", k.cast("int")))
        .when(got == -want, "sign_error")
        .when(looping, "repetition_loop")
        .otherwise("wrong_value")
    )


def preference_loss(chosen: Column, rejected: Column, l2: float = 0.0) -> Column:
    """Bradley-Terry loss with a penalty on the rewards' size, as an aggregate."""
    return F.avg(F.log1p(F.exp(rejected - chosen))) + l2 * F.avg(chosen * chosen + rejected * rejected)
