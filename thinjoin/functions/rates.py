"""Closed forms over the moment columns: variances and variance-optimal rates.

``e1``, ``e2`` are the budgets (fractions of rows kept), ``p`` the universe rate, ``q1 = e1/p`` and ``q2 = e2/p`` the
Bernoulli rates. Moment columns are named in ``operators.moments``: ``a`` rows of the left table per key, ``b`` rows
of the right table, ``x`` left rows with a measure, ``s`` its sum and ``q`` the sum of its squares.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column


@dataclass(frozen=True)
class Rates:
    """Literal sampling rates."""

    p: float
    q1: float
    q2: float

    @classmethod
    def preset(cls, p: float, q: float) -> Rates:
        return cls(float(p), float(q), float(q))

    @classmethod
    def from_budget(cls, p: float, e1: float, e2: float) -> Rates:
        return cls(float(p), e1 / p, e2 / p)


# The (p, q) presets swept per row budget.
PRESETS = {
    "0.1%": ((0.001, 1.0), (0.0015, 0.666), (0.003, 0.333), (0.333, 0.003), (0.666, 0.0015), (1.0, 0.001)),
    "1%": ((0.01, 1.0), (0.015, 0.666), (0.03, 0.333), (0.333, 0.03), (0.666, 0.015), (1.0, 0.01)),
    "2%": ((0.02, 1.0), (0.04, 0.5), (0.08, 0.25), (0.25, 0.08), (0.5, 0.04), (1.0, 0.02)),
    "10%": ((0.1, 1.0), (0.15, 0.666), (0.3, 0.333), (0.333, 0.3), (0.666, 0.15), (1.0, 0.1)),
}


def column(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def budget_floor(e1: Number, e2: Number) -> Column:
    """Smallest universe rate for which both Bernoulli rates stay at or below 1."""
    return F.greatest(column(e1), column(e2))


def clamp_rate(rate: Column, e1: Number, e2: Number) -> Column:
    return F.least(F.lit(1.0), F.greatest(budget_floor(e1, e2), rate))


def variance_weights(p: Number, e1: Number, e2: Number) -> tuple[Column, Column, Column, Column]:
    """Weights of the (both tables, left rows, right rows, row pairs) terms of a variance."""
    p, e1, e2 = column(p), column(e1), column(e2)
    return 1 / p - 1, 1 / e2 - 1 / p, 1 / e1 - 1 / p, p / (e1 * e2) - 1 / e1 - 1 / e2 + 1 / p


def _weighted(weights, names) -> Column:
    terms = [w * F.col(n) for w, n in zip(weights, names, strict=True)]
    return terms[0] + terms[1] + terms[2] + terms[3]


def count_variance(p: Number, e1: Number, e2: Number) -> Column:
    return _weighted(variance_weights(p, e1, e2), ("a2b2", "a2b", "ab2", "ab"))


def sum_variance(p: Number, e1: Number, e2: Number) -> Column:
    return _weighted(variance_weights(p, e1, e2), ("s2b2", "s2b", "qb2", "qb"))


def avg_variance(p: Number, e1: Number, e2: Number) -> Column:
    """First-order (delta method) variance of the ratio SUM / COUNT of non-null measures."""
    weights = variance_weights(p, e1, e2)
    counts = _weighted(weights, ("x2b2", "x2b", "xb2", "xb"))
    sums = _weighted(weights, ("s2b2", "s2b", "qb2", "qb"))
    both = _weighted(weights, ("xsb2", "xsb", "sb2", "sb"))
    total, rows = F.col("sb"), F.col("xb")
    relative = (
        F.try_divide(sums, total * total) - F.try_divide(2 * both, total * rows) + F.try_divide(counts, rows * rows)
    )
    return F.try_divide(total, rows) * F.try_divide(total, rows) * relative


VARIANCES = {"count": count_variance, "sum": sum_variance, "avg": avg_variance}


def objective(agg: str, e1: Number, e2: Number) -> tuple[Column, Column]:
    """``(val1, val2)`` such that the variance varies with ``p`` as ``val1 / p + val2 * p``.

    COUNT and SUM are scaled by ``e1 * e2``; AVG is relative to the squared average.
    """
    e1, e2 = column(e1), column(e2)
    if agg == "count":
        return e1 * e2 * (F.col("a2b2") - F.col("a2b") - F.col("ab2") + F.col("ab")), F.col("ab")
    if agg == "sum":
        return e1 * e2 * (F.col("s2b2") - F.col("s2b") - F.col("qb2") + F.col("qb")), F.col("qb")
    if agg == "avg":
        total, rows = F.col("sb"), F.col("xb")
        sums = F.try_divide(F.col("qb") + F.col("s2b2") - F.col("s2b") - F.col("qb2"), total * total)
        both = F.try_divide(F.lit(1.0), rows) + F.try_divide(F.col("xsb2") - F.col("xsb") - F.col("sb2"), rows * total)
        counts = F.try_divide(F.col("xb") + F.col("x2b2") - F.col("x2b") - F.col("xb2"), rows * rows)
        pairs = F.try_divide(F.col("qb"), total * total) - F.try_divide(F.lit(1.0), rows)
        return sums - 2 * both + counts, pairs / (e1 * e2)
    raise ValueError(f"unknown aggregate: {agg}")


def best_rate(val1: Column, val2: Column, e1: Number, e2: Number) -> Column:
    """Minimise ``val1 / p + val2 * p`` over ``[max(e1, e2), 1]``."""
    low, one = budget_floor(e1, e2), F.lit(1.0)
    interior = clamp_rate(F.sqrt(F.try_divide(val1, val2)), e1, e2)
    return (
        F.when((val1 <= 0) & (val2 > 0), low)
        .when((val1 > 0) & (val2 <= 0), one)
        .when((val1 > 0) & (val2 > 0), interior)
        .when(val1 / low + val2 * low < val1 + val2, low)
        .when(val1.isNotNull() & val2.isNotNull(), one)
    )
