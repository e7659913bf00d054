"""Moment sums over the keys two tables share.

Every variance and every optimal rate is a function of these sixteen sums, so one row is all that planning needs.
``a2b`` is the sum over keys of a^2 * b, ``qb2`` of q * b^2, and so on. Each term has a factor ``a * b``, so an inner
join of the per-key statistics is enough. Both inputs come from ``groupBy(key)`` and are already partitioned by key:
the join adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_MOMENTS = ("ab", "a2b", "ab2", "a2b2")
MEASURE_MOMENTS = (
    "xb", "x2b", "xb2", "x2b2",
    "sb", "sb2", "s2b", "s2b2",
    "qb", "qb2",
    "xsb", "xsb2",
)
MOMENTS = COUNT_MOMENTS + MEASURE_MOMENTS


def moment_terms(a: Column, x: Column, s: Column, q: Column, b: Column) -> dict[str, Column]:
    """One key's contribution to each moment."""
    b2 = b * b
    return {
        "ab": a * b, "a2b": a * a * b, "ab2": a * b2, "a2b2": a * a * b2,
        "xb": x * b, "x2b": x * x * b, "xb2": x * b2, "x2b2": x * x * b2,
        "sb": s * b, "sb2": s * b2, "s2b": s * s * b, "s2b2": s * s * b2,
        "qb": q * b, "qb2": q * b2,
        "xsb": x * s * b, "xsb2": x * s * b2,
    }


def column_terms(with_measure: bool = True) -> dict[str, Column]:
    a, b = F.col("a"), F.col("b")
    if with_measure:
        return moment_terms(a, F.col("x"), F.col("s"), F.col("q"), b)
    zero = F.lit(0.0)
    terms = moment_terms(a, zero, zero, zero, b)
    return {name: terms[name] for name in COUNT_MOMENTS}


def moments(left_stats: DataFrame, right_counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the join, one row, or one row per ``by`` value carried in ``left_stats``."""
    with_measure = "s" in left_stats.columns
    shared = left_stats.join(right_counts, "key")
    sums = [F.coalesce(F.sum(term), F.lit(0.0)).alias(name) for name, term in column_terms(with_measure).items()]
    return shared.groupBy(*by).agg(*sums) if by else shared.agg(*sums)
