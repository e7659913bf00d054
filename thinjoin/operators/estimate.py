"""Estimates of COUNT, SUM and AVG over a join from a sample pair.

The sampled sides are aggregated per (replicate, key) before they are joined, so a hot key costs one row per side and
the join runs on the partitioning the aggregates left behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY
from thinjoin.functions.rates import Rates
from thinjoin.operators.keystats import key_counts, key_stats, stat_columns
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import RateSource, SamplePair, Side, sample_pair


def scale_factor(rates: RateSource) -> Column:
    """``1 / (p * q1 * q2)``; for a preset sweep, looked up by the ``preset`` column."""
    if isinstance(rates, Rates):
        return F.lit(_inverse(rates.p, rates.q1, rates.q2))
    factors = F.array(*[F.lit(_inverse(r.p, r.q1, r.q2)) for r in rates])
    return F.element_at(factors, F.col("preset") + 1)


def _inverse(p: float, q1: float, q2: float) -> float:
    return 1.0 / (p * q1 * q2)


def sample_key_stats(sample: DataFrame, key: str, measure: str | None, by: Sequence[str] = ()) -> DataFrame:
    return sample.groupBy(*DRAW_KEY, *by, F.col(key).alias("key")).agg(*stat_columns(measure))


def sample_totals(pair: SamplePair, measure: str) -> DataFrame:
    """Unscaled joined rows and sums of every draw; a draw whose samples do not meet has zeros."""
    left = sample_key_stats(pair.left, pair.left_key, measure)
    right = sample_key_stats(pair.right, pair.right_key, None).withColumnRenamed("a", "b")
    shared = left.join(right, [*DRAW_KEY, "key"])
    met = shared.select(*DRAW_KEY, *[(F.col(c) * F.col("b")).alias(n) for c, n in _TOTALS.items()])
    none = pair.draw_table().select(*DRAW_KEY, *[F.lit(0.0).alias(n) for n in _TOTALS.values()])
    return met.unionByName(none).groupBy(*DRAW_KEY).agg(*[F.sum(n).alias(n) for n in _TOTALS.values()])


_TOTALS = {"a": "n_join", "x": "x_join", "s": "s_join"}


def estimate_columns(scale: Column) -> dict[str, Column]:
    """Scaled estimates; AVG is a ratio, so the scale cancels. An empty sample estimates 0."""
    zero = F.lit(0.0)
    return {
        "count_estimate": F.coalesce(F.col("n_join") * scale, zero),
        "sum_estimate": F.coalesce(F.col("s_join") * scale, zero),
        "avg_estimate": F.coalesce(F.try_divide(F.col("s_join"), F.col("x_join")), zero),
    }


def estimates(
    pair: SamplePair,
    measure: str,
    left_where: Column | None = None,
    right_where: Column | None = None,
) -> DataFrame:
    """One row per draw. Predicates apply to the stored sample, so one sample serves many filters."""
    filtered = restrict(pair, left_where, right_where)
    totals = sample_totals(filtered, measure)
    return totals.select(*DRAW_KEY, *[c.alias(n) for n, c in estimate_columns(scale_factor(pair.rates)).items()])


def grouped_estimates(pair: SamplePair, measure: str, by: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """One row per draw and ``by`` value, columns of the left table; NULL is a group.

    Groups that a draw has not met are there, with 0, if ``groups`` lists them.
    """
    left = sample_key_stats(pair.left, pair.left_key, measure, by).where(F.col("key").isNotNull())
    right = sample_key_stats(pair.right, pair.right_key, None).withColumnRenamed("a", "b")
    shared = left.join(right, [*DRAW_KEY, "key"])
    met = shared.select(*DRAW_KEY, *by, *[(F.col(c) * F.col("b")).alias(n) for c, n in _TOTALS.items()])
    if groups is not None:
        every = groups.select(*by).distinct().select(*by, F.inline(pair.draws.identities()).alias(*DRAW_KEY))
        met = met.unionByName(every.select(*DRAW_KEY, *by, *[F.lit(0.0).alias(n) for n in _TOTALS.values()]))
    totals = met.groupBy(*DRAW_KEY, *by).agg(*[F.sum(n).alias(n) for n in _TOTALS.values()])
    return totals.select(*DRAW_KEY, *by, *[c.alias(n) for n, c in estimate_columns(scale_factor(pair.rates)).items()])


def restrict(pair: SamplePair, left_where: Column | None, right_where: Column | None) -> SamplePair:
    """The pair with a predicate on either side."""
    left = pair.left if left_where is None else pair.left.where(left_where)
    right = pair.right if right_where is None else pair.right.where(right_where)
    return SamplePair(left, right, pair.left_key, pair.right_key, pair.rates, pair.draws)


def average_from_two_pairs(count_pair: SamplePair, sum_pair: SamplePair, measure: str) -> DataFrame:
    """AVG as the SUM of a SUM-optimal pair over the COUNT of a COUNT-optimal pair."""
    counts, sums = estimates(count_pair, measure), estimates(sum_pair, measure)
    both = counts.select(*DRAW_KEY, "count_estimate").join(sums.select(*DRAW_KEY, "sum_estimate"), list(DRAW_KEY))
    ratio = F.coalesce(F.try_divide(F.col("sum_estimate"), F.col("count_estimate")), F.lit(0.0))
    return both.withColumn("avg_estimate", ratio)


def relative_error(estimate: Column, actual: Column) -> Column:
    return F.abs(F.try_divide(estimate - actual, actual))


def approx_join_agg(
    left: Side,
    right: Side,
    measure: str,
    agg: str,
    e1: float,
    e2: float,
    replicates: int = 1,
    seed: int = 1,
    left_where: Column | None = None,
    right_where: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Plan, sample and estimate; the predicates hold for planning and sampling alike.

    With ``by``, columns of the left table, there is a row for each group of the left table in each draw; a group that
    the sample has not met is estimated as 0.
    """
    from thinjoin.plans.central import sampling_rates

    left = left if left_where is None else Side(left.table.where(left_where), left.key, left.row_id)
    right = right if right_where is None else Side(right.table.where(right_where), right.key, right.row_id)
    found = moments(key_stats(left.table, left.key, measure), key_counts(right.table, right.key))
    pair = sample_pair(left, right, sampling_rates(found, agg, e1, e2), replicates, seed)
    found = grouped_estimates(pair, measure, by, left.table) if by else estimates(pair, measure)
    return found.select(*DRAW_KEY, *by, F.col(f"{agg}_estimate").alias("estimate"))
