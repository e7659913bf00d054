"""Rates when statistics of both tables are at hand.

Each planner maps moments to rows of ``p``, ``q1``, ``q2`` with the objective values and a status, and stays lazy:
the samplers read the row as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.rates import PRESETS, VARIANCES, best_rate, clamp_rate, column, objective


def with_rates(planned: DataFrame, e1: float, e2: float) -> DataFrame:
    """Add ``p``, ``q1``, ``q2`` to rows that hold ``val1`` and ``val2``."""
    rate = best_rate(F.col("val1"), F.col("val2"), e1, e2)
    return planned.withColumn("p", rate).withColumns(
        {"q1": F.lit(float(e1)) / F.col("p"), "q2": F.lit(float(e2)) / F.col("p")}
    )


def plan_status(agg: str) -> Column:
    """Why a plan has no rate: nothing joins, or the measure's sum is zero where AVG divides by it."""
    status = F.when(F.col("ab") == 0, F.lit("empty join"))
    if agg == "avg":
        status = status.when(F.col("xb") == 0, F.lit("no measure")).when(F.col("sb") == 0, F.lit("sum is zero"))
    return status.otherwise(F.lit("ok"))


def sampling_rates(moments: DataFrame, agg: str, e1: float, e2: float) -> DataFrame:
    """Variance-optimal rates for one aggregate, one row per row of ``moments``."""
    val1, val2 = objective(agg, e1, e2)
    other = [c for c in moments.columns if c not in _moment_names()]
    usable = plan_status(agg) == "ok"
    planned = moments.select(
        *other,
        F.lit(agg).alias("agg"),
        F.when(usable, val1).alias("val1"),
        F.when(usable, val2).alias("val2"),
        plan_status(agg).alias("status"),
    )
    return with_rates(planned, e1, e2)


def _moment_names() -> set[str]:
    from thinjoin.operators.moments import MOMENTS

    return set(MOMENTS)


def joint_rates(moments: DataFrame, e1: float, e2: float) -> DataFrame:
    """One pair for COUNT, SUM and AVG: their objectives, each over its squared exact answer, added up."""
    answers = {
        "count": F.col("ab"),
        "sum": F.col("sb"),
        "avg": F.try_divide(F.col("sb"), F.col("xb")),
    }
    val1, val2 = F.lit(0.0), F.lit(0.0)
    for agg, answer in answers.items():
        one, two = objective(agg, e1, e2)
        val1 = val1 + F.try_divide(one, answer * answer)
        val2 = val2 + F.try_divide(two, answer * answer)
    planned = moments.select(val1.alias("val1"), val2.alias("val2"), plan_status("avg").alias("status"))
    return with_rates(planned, e1, e2)


def exact_and_sketched_rates(exact: DataFrame, sketched: DataFrame, e1: float, e2: float) -> DataFrame:
    """The AVG plan from exact moments beside the one from sketched moments."""
    other = sampling_rates(sketched, "avg", e1, e2)
    found = other.select(F.struct("val1", "val2", "p").alias("found")).scalar()
    planned = sampling_rates(exact, "avg", e1, e2).select("val1", "val2", "p")
    return planned.withColumns({f"{n}_sketched": found.getField(n) for n in ("val1", "val2", "p")})


def pooled_rates(moments: DataFrame, agg: str, e1: float, e2: float, weight: Column | None = None) -> DataFrame:
    """One rate for many predicate values or groups: their objectives added up, optionally weighted.

    Values for which the aggregate is undefined (nothing joins) contribute nothing.
    """
    val1, val2 = objective(agg, e1, e2)
    share = F.lit(1.0) if weight is None else weight
    planned = moments.agg(F.sum(share * val1).alias("val1"), F.sum(share * val2).alias("val2"))
    return with_rates(planned, e1, e2)


def variance_curve(moments: DataFrame, e1: float, e2: float, rates: Sequence[float]) -> DataFrame:
    """Theoretical variances at each universe rate of a literal list."""
    return _at_settings(moments, [(float(p), float(e1), float(e2)) for p in rates])


def preset_variances(moments: DataFrame, budgets: Sequence[str] = tuple(PRESETS)) -> DataFrame:
    """Theoretical variances of every preset (p, q) of the named budgets."""
    settings = [(budget, p, q, p * q, p * q) for budget in budgets for p, q in PRESETS[budget]]
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("budget"), *[F.lit(v).alias(n) for n, v in zip(("p", "q", "e1", "e2"), rest, strict=True)])
            for b, *rest in settings
        ]
    )
    fanned = moments.select("*", F.inline(rows).alias("budget", "p", "q", "e1", "e2"))
    return fanned.select("budget", "p", "q", *_variance_columns())


def _at_settings(moments: DataFrame, settings: Sequence[tuple[float, float, float]]) -> DataFrame:
    names = ("p", "e1", "e2")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in settings])
    return moments.select("*", F.inline(rows).alias(*names)).select(*names, *_variance_columns())


def _variance_columns() -> list[Column]:
    at = (F.col("p"), F.col("e1"), F.col("e2"))
    return [form(*at).alias(f"{agg}_variance") for agg, form in VARIANCES.items()]


def key_and_predicate_rates(whole: DataFrame, by_value: DataFrame, e1: float, e2: float) -> DataFrame:
    """COUNT rates without and with the predicate values' terms added to those of the unfiltered join."""
    val1, val2 = objective("count", e1, e2)
    plain = whole.select(val1.alias("val1"), val2.alias("val2"))
    values = by_value.agg(F.sum(val1).alias("v1"), F.sum(val2).alias("v2"))
    extra = values.select(F.struct("v1", "v2").alias("v")).scalar()
    with_values = plain.select(
        F.sqrt(F.try_divide(F.col("val1"), F.col("val2"))).alias("rate_key"),
        F.sqrt(F.try_divide(F.col("val1") + extra.getField("v1"), F.col("val2") + extra.getField("v2"))).alias(
            "rate_key_and_predicate"
        ),
    )
    return with_values.withColumn("p", clamp_rate(F.col("rate_key_and_predicate"), column(e1), column(e2)))
