"""Stratified sample pairs and grouped estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinjoin.functions.hashing import (
    DRAW_KEY,
    RANGE,
    Draws,
    coefficients_needed,
    comparison_type,
    fine_hash,
    hash_parts,
    limit_of,
    polynomial_hash,
)
from thinjoin.operators.estimate import sample_key_stats
from thinjoin.operators.keystats import group_profile
from thinjoin.operators.sampling import Side, hash_below
from thinjoin.operators.skew import fits_broadcast, join_by_key
from thinjoin.session import settle

#: Factor by which the hash bound of a group with too few candidates grows per round.
WIDEN = 4.0
#: Intervals into which ranks are counted at a time, and rows of a group that are ranked at the end.
FAN = 1024
RANKED = 10_000


@dataclass(frozen=True)
class GroupedSample:
    """Samples of both sides, the per-group parameters they were drawn with, and the draws."""

    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    group: str
    parameters: DataFrame
    draws: Draws

    def draw_table(self) -> DataFrame:
        return self.draws.table(self.left.sparkSession)


def sample_draws(left: Side, right: Side, replicates: int | Sequence[int], seed: int, *extra: str) -> Draws:
    numbers = tuple(range(1, replicates + 1)) if isinstance(replicates, int) else tuple(replicates)
    roles = {"key": coefficients_needed(1), "left": coefficients_needed(len(left.row_id))}
    roles["right"] = coefficients_needed(len(right.row_id))
    roles.update({name: coefficients_needed(len(left.row_id)) for name in extra})
    return Draws(seed, numbers, roles)


def universe_strata_pair(
    left: Side, right: Side, group: str, parameters: DataFrame, replicates: int | Sequence[int] = 1, seed: int = 1
) -> GroupedSample:
    """Major groups share a universe rate, minor groups keep every key; all groups and replicates in one job.

    ``parameters`` (``plans.strata.group_parameters``) is written once to the shared folder; its counted size decides
    between a broadcast and a shuffle join. The right table is read once, each row flagged for the major sample, the
    minor sample or both. Left rows carry their group's class and the key's hash value ``pval``.
    """
    parameters = settle(parameters, "group-parameters")
    key_type = comparison_type(left.table, left.key, right.table, right.key)
    draws = sample_draws(left, right, replicates, seed)

    present = left.table.where(F.col(left.key).isNotNull())
    rates = parameters.select(F.col("grp").alias("_grp"), "is_major", F.col("p1").alias("_p1"), F.col("q1").alias("_q1"))
    fanned, draw = draws.attach(join_by_key(present, group, rates, "_grp"))
    key_hash = polynomial_hash(hash_parts(present, [left.key], key_type), lambda i: draw(f"key_{i}"))
    kept_left = fanned.where(
        hash_below(present, [left.key], "key", draw, F.col("_p1"), key_type)
        & hash_below(present, left.row_id, "left", draw, F.col("_q1"))
    ).select(*DRAW_KEY, *left.table.columns, "is_major", key_hash.alias("pval"))

    present = right.table.where(F.col(right.key).isNotNull())
    fanned, draw = draws.attach(present)
    one = parameters.select(F.struct(F.max("p2_major"), F.max("q2_major"), F.max("q2_minor")).alias("r")).scalar()
    p_major, q_major, q_minor = (one.getField(f"col{i}") for i in (1, 2, 3))
    flagged = fanned.withColumns(
        {
            "in_major": hash_below(present, [right.key], "key", draw, p_major, key_type)
            & hash_below(present, right.row_id, "right", draw, q_major),
            "in_minor": hash_below(present, right.row_id, "right", draw, q_minor),
        }
    )
    kept_right = flagged.where("in_major OR in_minor").select(*DRAW_KEY, *right.table.columns, "in_major", "in_minor")
    return GroupedSample(kept_left, kept_right, left.key, right.key, group, parameters, draws)


def fixed_size_strata(left: Side, group: str, limit: int, q: float) -> DataFrame:
    """Strata of a K-rows-per-group sample: *low* groups (fewer than ``limit`` rows expected at rate ``q``) are cut to
    ``limit`` rows, the others are thinned at rate ``q``."""
    profile = group_profile(left.table, group, left.key)
    low = F.col("n_rows") * F.lit(float(q)) < F.lit(float(limit))
    return profile.select(
        "grp", "n_rows", low.alias("is_low"), F.lit(float(limit)).alias("k"), F.lit(float(q)).alias("q")
    )


def fixed_size_strata_pair(
    left: Side,
    right: Side,
    group: str,
    limit: int,
    q: float,
    replicates: int | Sequence[int] = 1,
    seed: int = 1,
    slack: float = 6.0,
) -> GroupedSample:
    """``limit`` random rows of each low group, Bernoulli rows of the others, Bernoulli rows of the right table.

    The ``limit`` rows are those with the smallest 62-bit hash. They are looked for among the rows below a hash bound that
    lets through slightly more than ``limit`` rows of a group. The candidates are stored and counted; for a group with too few
    of them, which is rare, the bound is widened in rounds, and only what it lets through anew is added. Which candidates
    are the smallest is found by counting (``smallest``): neither a group nor its ``limit`` rows are ranked in one place.
    ``slack`` sets the surplus, in standard deviations of the number of candidates; the sample is the same for any value.
    """
    strata = settle(fixed_size_strata(left, group, limit, q), "strata")
    draws = sample_draws(left, right, replicates, seed, "rank")
    columns = [*DRAW_KEY, *left.table.columns]

    bound = F.least(F.lit(1.0), F.lit(limit + slack * limit**0.5 + 5 * slack) / F.col("n_rows"))
    marks = strata.select(F.col("grp").alias("_grp"), F.col("is_low").alias("_low"), bound.alias("_bound"))
    fanned, draw = draws.attach(join_by_key(left.table, group, marks, "_grp"))
    high = fanned.where(~F.col("_low") & hash_below(left.table, left.row_id, "left", draw, F.lit(q)))
    rank = fine_hash(left.table, left.row_id, "rank", draw).alias("_rank")
    near = rank < limit_of(F.col("_bound"))
    candidates = settle(fanned.where(F.col("_low") & near).select(*columns, rank), "candidates")

    low = strata.where("is_low").select("grp", "n_rows", bound.alias("_to"), F.inline(draws.identities()).alias("_preset", "_replicate"))
    asked = F.least(F.lit(limit), F.col("n_rows"))
    while True:
        found = candidates.groupBy(*DRAW_KEY, F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_found"))
        same = [F.col("grp").eqNullSafe(F.col("_group")), *[F.col(f"_{k}") == F.col(k) for k in DRAW_KEY]]
        short = low.join(found, same, "left").where((F.coalesce("_found", F.lit(0)) < asked) & (F.col("_to") < 1))
        wider = F.least(F.lit(1.0), F.col("_to") * WIDEN)
        low = settle(short.select("grp", "n_rows", F.col("_to").alias("_from"), wider.alias("_to"), "_preset", "_replicate"), "short-groups")
        if low.isEmpty():
            break
        more = low.select(F.col("grp").alias("_short"), "_from", "_to", *[F.col(f"_{k}").alias(f"_of_{k}") for k in DRAW_KEY])
        again = [F.col("_grp").eqNullSafe(F.col("_short")), *[F.col(f"_of_{k}") == F.col(k) for k in DRAW_KEY]]
        ranked = fanned.where("_low").withColumn("_rank", rank).join(F.broadcast(more) if fits_broadcast(more) else more, again)
        rest = ranked.where((F.col("_rank") >= limit_of(F.col("_from"))) & (F.col("_rank") < limit_of(F.col("_to"))))
        candidates = candidates.unionByName(settle(rest.select(*columns, "_rank"), "candidates"))
    kept_low = smallest(candidates, [*DRAW_KEY, group], "_rank", left.row_id, limit)
    kept_left = high.select(*columns).unionByName(kept_low.select(*columns))

    fanned, draw = draws.attach(right.table)
    kept_right = fanned.where(hash_below(right.table, right.row_id, "right", draw, F.lit(q)))
    kept_right = kept_right.select(*DRAW_KEY, *right.table.columns)
    return GroupedSample(kept_left, kept_right, left.key, right.key, group, strata, draws)


def smallest(rows: DataFrame, by: Sequence[str], rank: str, ties: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows of each ``by`` group with the smallest 62-bit ``rank``; equal ranks by the columns ``ties``.

    ``rows`` is read several times and should be stored. Ranks are counted in ``FAN`` equal intervals, with map-side
    combination; the interval in which a group's count crosses ``limit`` is counted again in ``FAN`` parts, until few rows lie in it. All rows below
    are kept, and only those in it are ranked.
    """
    named = [f"_of_{c}" for c in by]
    counts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, named, strict=True)]).agg(F.count(F.lit(1)).alias("_in"))
    full = counts.where(F.col("_in") > limit)
    bounds = settle(full.select(*named, F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_before"), "_in"), "rank-bounds")
    width = RANGE

    def within(bounds: DataFrame, how: str) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, named, strict=True)]
        return rows.join(F.broadcast(bounds) if fits_broadcast(bounds) else bounds, same, how)

    while width > 1 and not bounds.where(F.col("_in") > RANKED).isEmpty():
        part = -(-width // FAN)
        inside = within(bounds, "inner").where((F.col(rank) >= F.col("_low")) & (F.col(rank) - F.col("_low") < width))
        at = F.expr(f"({rank} - _low) div {part}")
        parts = inside.groupBy(*named, "_low", "_before", at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        so_far = F.sum("_n").over(Window.partitionBy(*named).orderBy("_at"))  # at most FAN rows of a group
        parts = parts.withColumn("_to", F.col("_before") + so_far)
        crossing = parts.where((F.col("_to") >= limit) & (F.col("_to") - F.col("_n") < limit))
        low = F.col("_low") + F.col("_at") * F.lit(part)
        before = F.col("_to") - F.col("_n")
        bounds = settle(crossing.select(*named, low.alias("_low"), before.alias("_before"), F.col("_n").alias("_in")), "rank-bounds")
        width = part
    placed = within(bounds, "left")
    sure = placed.where(F.col("_low").isNull() | (F.col(rank) < F.col("_low"))).select(*rows.columns)
    edge = placed.where((F.col(rank) >= F.col("_low")) & (F.col(rank) - F.col("_low") < width))
    order = Window.partitionBy(*by).orderBy(rank, *ties)
    last = edge.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.lit(limit) - F.col("_before"))
    return sure.unionByName(last.select(*rows.columns))


def _group_totals(sample: GroupedSample, measure: str, matches: Column) -> DataFrame:
    """Joined rows and sums per (draw, group); ``matches`` is the number of right rows a left row meets."""
    classes = [c for c in ("is_major",) if c in sample.left.columns]
    left = sample_key_stats(sample.left, sample.left_key, measure, [sample.group, *classes])
    left = left.withColumnRenamed(sample.group, "grp").where(F.col("key").isNotNull())
    flags = [c for c in ("in_major", "in_minor") if c in sample.right.columns]
    counts = [F.count(F.lit(1)).cast("double").alias("b_all")] + [F.sum(F.col(c).cast("double")).alias(c) for c in flags]
    right = sample.right.groupBy(*DRAW_KEY, F.col(sample.right_key).alias("key")).agg(*counts)
    shared = left.join(right, [*DRAW_KEY, "key"])
    shared = shared.withColumn("b", matches).where("b > 0")
    return shared.groupBy(*DRAW_KEY, "grp").agg(
        F.sum(F.col("a") * F.col("b")).alias("n_join"),
        F.sum(F.col("x") * F.col("b")).alias("x_join"),
        F.sum(F.col("s") * F.col("b")).alias("s_join"),
    )


def _every_group(sample: GroupedSample, totals: DataFrame, scale: Column, columns: Sequence[str]) -> DataFrame:
    """Estimates of every group in every draw: a group the sample missed is reported with 0 and ``seen`` false.

    A group without a rate, because its class asked for more than the budget, was not sampled: its estimates are NULL.
    """
    every = sample.parameters.select("grp", *columns, F.inline(sample.draws.identities()).alias(*DRAW_KEY))
    found = totals.withColumnRenamed("grp", "_grp").withColumnsRenamed({k: f"_{k}" for k in DRAW_KEY})
    same = [F.col(k) == F.col(f"_{k}") for k in DRAW_KEY]
    joined = every.join(found, [F.col("grp").eqNullSafe(F.col("_grp")), *same], "left")
    zero = F.when(scale.isNotNull(), F.lit(0.0))
    return joined.select(
        *DRAW_KEY,
        "grp",
        F.coalesce(F.col("n_join") * scale, zero).alias("count_estimate"),
        F.coalesce(F.col("s_join") * scale, zero).alias("sum_estimate"),
        F.coalesce(F.try_divide("s_join", "x_join"), zero).alias("avg_estimate"),
        F.col("n_join").isNotNull().alias("seen"),
        *([F.col("status")] if "status" in columns else []),
    )


def universe_strata_estimates(sample: GroupedSample, measure: str) -> DataFrame:
    """Grouped estimates with each group's ``status``; major groups meet the major right sample, minor groups the minor one."""
    major = F.col("is_major") == 1
    totals = _group_totals(sample, measure, F.when(major, F.col("in_major")).otherwise(F.col("in_minor")))
    q2 = F.when(major, F.col("q2_major")).otherwise(F.col("q2_minor"))
    scale = F.try_divide(F.lit(1.0), F.col("p1") * F.least(F.col("q1"), F.lit(1.0)) * q2)
    return _every_group(sample, totals, scale, ["is_major", "status", "p1", "q1", "q2_major", "q2_minor"])


def fixed_size_strata_estimates(sample: GroupedSample, measure: str) -> DataFrame:
    """Grouped estimates from a K-rows-per-group sample."""
    totals = _group_totals(sample, measure, F.col("b_all"))
    n, k, q = F.col("n_rows"), F.col("k"), F.col("q")
    scale = F.when(n * q >= k, 1 / (q * q)).when(k >= n, 1 / q).otherwise(n / k / q)
    return _every_group(sample, totals, scale, ["n_rows", "k", "q"])
