"""Numeric scalars: judge scores, intervals, decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a judge's score is worth if its completion could not be parsed.
MASKED = -1e30
Z_TWO_SIDED, Z_ONE_SIDED = 1.959963984540054, 1.6448536269514722


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_failed(has_parsed, parsed) -> Column:
    """A ``parsed`` that is there and null; one that is absent is no failure."""
    return _col(has_parsed) & _col(parsed).isNull()


def effective_score(score, failed) -> Column:
    """The score, masked after a parse failure; not finite is an error."""
    s = _col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < math.inf)
    return F.when(~finite, F.raise_error(F.lit("judge score is not a finite number"))).when(_col(failed), F.lit(MASKED)).otherwise(s)


def clipped_sigmoid(x, limit: float = 40.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), _col(x)))))


def ratio(a, b, default: float | None = 0.0) -> Column:
    """``a / b``, or the default where ``b`` is 0."""
    return F.when(_col(b) == 0, F.lit(default).cast("double")).otherwise(F.try_divide(_col(a).cast("double"), _col(b).cast("double")))


def wilson_interval(successes, n, z: float = Z_TWO_SIDED) -> Column:
    """``(low, high)`` within 0 .. 1; counts out of order are an error."""
    s, m = _col(successes).cast("double"), _col(n).cast("double")
    p, w = s / m, 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / w
    middle = (p + z * z / (2 * m)) / w
    good = (m > 0) & (s >= 0) & (s <= m)
    both = F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high"))
    return F.when(good, both).otherwise(F.raise_error(F.lit("counts out of order")))


def wilson_upper(errors, n, z: float = Z_ONE_SIDED) -> Column:
    """One-sided upper bound of a rate; 1 without trials."""
    e, m = _col(errors).cast("double"), _col(n).cast("double")
    p = e / F.nullif(m, F.lit(0.0))
    upper = (p + z * z / (2 * m) + z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.when(m == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), upper))


def resource_decision(headroom, avoidable) -> Column:
    """Five outcomes by quality headroom and avoidable share of searches."""
    h, a = _col(headroom), _col(avoidable)
    return (
        F.when(h >= 0.05, "STRONG_QUALITY_HEADROOM")
        .when((h >= 0.02) & (a >= 0.20), "QUALITY_COST_PARETO")
        .when(h >= 0.02, "MODERATE_QUALITY_HEADROOM")
        .when(a >= 0.20, "EFFICIENCY_ONLY")
        .otherwise("LOW_STOPPING_HEADROOM")
    )


def mean_binary(x) -> Column:
    """Mean of values that must all be 0 or 1, and at least one."""
    good = F.coalesce(F.bool_and(_col(x).isin(0, 1)), F.lit(False)) & (F.count("*") == F.count(_col(x)))
    return F.when(good, F.avg(_col(x))).otherwise(F.raise_error(F.lit("not all values are 0 or 1")))
