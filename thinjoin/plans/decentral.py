"""Rates when the two tables' statistics are never brought together.

Each side gives only a few numbers: its largest key frequency, its heaviest keys' sums, its row count. The rate then
guards against the worst way in which the keys could meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.rates import budget_floor, clamp_rate, column, variance_weights
from thinjoin.operators.moments import moments
from thinjoin.plans.central import sampling_rates

# Fixed value: share of the worst-case right table that falls on the left table's heaviest key.
WORST_CASE_SHARE = 0.75


def side_maximum(counts: DataFrame, name: str) -> DataFrame:
    """One row: the largest key frequency of a side."""
    return counts.agg(F.coalesce(F.max(name), F.lit(0.0)).alias(f"{name}_star"))


def worst_case_frequency(right: DataFrame) -> DataFrame:
    """One row: ``b_star`` if the right table put its worst-case share on one key."""
    return right.agg(F.floor(F.count(F.lit(1)) * F.lit(WORST_CASE_SHARE)).cast("double").alias("b_star"))


def count_rates(left_star: DataFrame, right_star: DataFrame, e1: float, e2: float) -> DataFrame:
    """COUNT: ``sqrt(e1 e2 (a* - 1)(b* - 1))`` from the two largest frequencies."""
    b_star = right_star.select("b_star").scalar()
    planned = left_star.select("a_star", b_star.alias("b_star"))
    pairs = F.col("a_star") * F.col("b_star") - F.col("a_star") - F.col("b_star") + 1
    rate = clamp_rate(F.sqrt(column(e1) * column(e2) * F.greatest(pairs, F.lit(0.0))), e1, e2)
    return planned.withColumn("p", rate).withColumns({"q1": F.lit(e1) / F.col("p"), "q2": F.lit(e2) / F.col("p")})


def count_variance_bound(rates: DataFrame, right: DataFrame, e1: float, e2: float) -> DataFrame:
    """Variance of COUNT if every right row met the left table's heaviest key."""
    n_b = right.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    known = rates.select("p", F.col("a_star").alias("a"), n_b.alias("n_b"))
    a, b = F.col("a"), F.col("n_b")
    terms = (a * a * b * b, a * a * b, a * b * b, a * b)
    weights = variance_weights(F.col("p"), e1, e2)
    bound = sum((w * t for w, t in zip(weights[1:], terms[1:], strict=True)), weights[0] * terms[0])
    return known.withColumn("variance_bound", bound)


def two_worst_keys(left_stats: DataFrame) -> DataFrame:
    """One row: (s^2, q) of the key with the largest s^2 and of the key with the largest q."""
    s2, q = F.col("s") * F.col("s"), F.col("q")
    top = left_stats.agg(F.max(F.struct(s2.alias("m"), q.alias("o"))).alias("u"), F.max(F.struct(q.alias("m"), s2.alias("o"))).alias("v"))
    return top.select(
        F.col("u.m").alias("s2_u"), F.col("u.o").alias("q_u"), F.col("v.o").alias("s2_v"), F.col("v.m").alias("q_v")
    )


def sum_rates(left_stats: DataFrame, right: DataFrame, e1: float, e2: float) -> DataFrame:
    """SUM: the rate that minimises the larger of the two worst keys' variances, all right rows on one key.

    Two convex curves cross at most twice on the axis, so the minimum of their maximum is at a crossing, at one of the
    curves' own minima, or at the lower bound. All five are evaluated and the best valid one is kept.
    """
    n_b = right.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    known = two_worst_keys(left_stats).withColumn("n_b", n_b)
    e1c, e2c, b = column(e1), column(e2), F.col("n_b")

    def variance(key: str, p: Column) -> Column:
        s2, q = F.col(f"s2_{key}"), F.col(f"q_{key}")
        w = variance_weights(p, e1, e2)
        return w[0] * s2 * b * b + w[1] * s2 * b + w[2] * q * b * b + w[3] * q * b

    def own_minimum(key: str) -> Column:
        s2, q = F.col(f"s2_{key}"), F.col(f"q_{key}")
        inner = F.try_divide(e1c * e2c * (s2 * b * b - s2 * b - q * b * b + q * b), q * b)
        return clamp_rate(F.sqrt(F.greatest(inner, F.lit(0.0))), e1, e2)

    ds, dq = F.col("s2_u") - F.col("s2_v"), F.col("q_u") - F.col("q_v")
    known = known.withColumns(
        {
            "c2": dq * b / (e1c * e2c),
            "c1": ds * b / e2c + dq * b * b / e1c - (1 / e1c + 1 / e2c) * dq * b - ds * b * b,
            "c0": dq * b + ds * b * b - ds * b - dq * b * b,
        }
    )
    known = known.withColumn("disc", F.col("c1") * F.col("c1") - 4 * F.col("c2") * F.col("c0"))
    real, quadratic = F.col("disc") >= 0, F.col("c2") != 0
    root = F.sqrt(F.greatest(F.col("disc"), F.lit(0.0)))
    known = known.withColumns(
        {
            "p1": F.when(real & quadratic, F.try_divide(-F.col("c1") - root, 2 * F.col("c2"))).when(
                ~quadratic, F.try_divide(-F.col("c0"), F.col("c1"))
            ),
            "p2": F.when(real & quadratic, F.try_divide(-F.col("c1") + root, 2 * F.col("c2"))),
            "p3": own_minimum("u"),
            "p4": own_minimum("v"),
            "p5": budget_floor(e1, e2),
        }
    )
    options = []
    for name in ("p1", "p2", "p3", "p4", "p5"):
        p = F.col(name)
        valid = p.isNotNull() & (p >= budget_floor(e1, e2)) & (p <= 1)
        worst = F.greatest(variance("u", p), variance("v", p))
        options.append(F.when(valid, F.struct(worst.alias("worst"), p.alias("p"))))
    best = known.withColumn("best", F.array_min(F.array_compact(F.array(*options))))
    chosen = best.select("s2_u", "q_u", "s2_v", "q_v", "n_b", F.col("best.p").alias("p"), F.col("best.worst").alias("worst"))
    return chosen.withColumns({"q1": F.lit(e1) / F.col("p"), "q2": F.lit(e2) / F.col("p")})


def avg_rates(left_stats: DataFrame, worst_right_counts: DataFrame, e1: float, e2: float) -> DataFrame:
    """AVG: the central plan against the key counts of a worst-case right table (``sources.synthetic``)."""
    return sampling_rates(moments(left_stats, worst_right_counts), "avg", e1, e2)
