"""Rates for GROUP BY queries: one shared universe rate, one row rate per group.

Groups with at least ``key_t`` distinct keys are *major* and share the universe rate; *minor* groups keep every key
(universe rate 1). ``row_t`` is the number of rows wanted from each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.rates import column
from thinjoin.session import settle


def split_groups(profile: DataFrame, key_t: float) -> DataFrame:
    """Mark each group of a profile (``grp``, ``n_rows``, ``n_keys``) as major (1) or minor (0)."""
    return profile.withColumn("is_major", (F.col("n_keys") >= F.lit(float(key_t))).cast("int"))


def proportional_rates(profile: DataFrame, key_t: float, row_t: float, e1: float) -> DataFrame:
    """``row_t`` rows for each group, and what the budget leaves, spread evenly over the rows of its class.

    A class whose groups ask for more than its budget is marked infeasible and gets no rate.
    """
    groups = split_groups(profile, key_t)
    classes = groups.groupBy("is_major").agg(
        F.count(F.lit(1)).cast("double").alias("class_groups"), F.sum("n_rows").alias("class_rows")
    )
    known = groups.join(F.broadcast(classes), "is_major")  # at most two rows: major and minor
    wanted, budget = F.lit(float(row_t)) * F.col("class_groups"), column(e1) * F.col("class_rows")
    feasible = wanted <= budget
    rate = F.lit(float(row_t)) / F.col("n_rows") + (budget - wanted) / F.col("class_rows")
    return known.select(
        "grp",
        "n_rows",
        "n_keys",
        "is_major",
        F.when(feasible, rate).alias("rate"),
        F.when(feasible, F.lit("ok")).otherwise(F.lit("budget exceeded")).alias("status"),
    )


def rebalanced_rates(profile: DataFrame, key_t: float, row_t: float, e1: float) -> DataFrame:
    """Half the budget for groups that reach ``row_t`` with it; the rest goes to the groups that do not."""
    half = column(e1) / 2
    groups = split_groups(profile, key_t).withColumn("enough", F.col("n_rows") * half >= F.lit(float(row_t)))
    totals = groups.agg(
        F.sum(F.when(F.col("enough"), F.col("n_rows") * half).otherwise(F.lit(0.0))).alias("saved"),
        F.sum((~F.col("enough")).cast("double")).alias("short_groups"),
    )
    share = totals.select(F.coalesce(F.try_divide("saved", "short_groups"), F.lit(0.0)).alias("share")).scalar()
    own = F.col("n_rows") * column(e1)
    rate = (
        F.when(F.col("enough"), half)
        .when(own >= F.lit(float(row_t)), column(e1))
        .otherwise(F.least(F.lit(1.0), (own + share) / F.col("n_rows")))
    )
    return groups.select("grp", "n_rows", "n_keys", "is_major", rate.alias("rate"), F.lit("ok").alias("status"))


def spent_budget_rates(profile: DataFrame, key_t: float, row_t: float, e1: float) -> DataFrame:
    """As ``rebalanced_rates``, but the expected rows are the budget, ``e1`` of all rows, and no rate exceeds 1.

    Groups that reach ``row_t`` with half their share keep that half. What they leave goes in equal parts to the groups that do not
    reach it with all of theirs; a part that a small group cannot use is given to the others, in rounds, until it is spent.
    What none of them can use goes back to the groups that gave it.
    """
    share = column(e1)
    rows, wanted = F.col("n_rows"), F.lit(float(row_t))
    groups = split_groups(profile, key_t)
    groups = groups.withColumn("kind", F.when(rows * share / 2 >= wanted, "gives").when(rows * share < wanted, "needs").otherwise("keeps"))
    groups = settle(groups.withColumn("room", rows - rows * share), "group-kinds")
    left, givers = groups.where("kind = 'gives'").agg(F.coalesce(F.sum(rows * share / 2), F.lit(0.0)), F.coalesce(F.sum(rows), F.lit(0.0))).first()
    needs = groups.where("kind = 'needs'")
    part, full = 0.0, -1
    while True:
        closed = F.col("room") <= F.lit(part)
        used, open_, now = needs.agg(
            F.coalesce(F.sum(F.when(closed, F.col("room"))), F.lit(0.0)), F.count(F.when(~closed, 1)), F.count(F.when(closed, 1))
        ).first()
        if now == full or not open_:
            break
        part, full = (left - used) / open_, now
    back = max(0.0, left - used) / givers if givers and not open_ else 0.0
    taken = F.least(F.col("room"), F.lit(part) if open_ else F.col("room"))
    rate = (
        F.when(F.col("kind") == "gives", share / 2 + F.lit(back))
        .when(F.col("kind") == "needs", (rows * share + taken) / rows)
        .otherwise(share)
    )
    return groups.select("grp", "n_rows", "n_keys", "is_major", rate.alias("rate"), F.lit("ok").alias("status"))


def group_parameters(group_rates: DataFrame, pooled: DataFrame, e2: float) -> DataFrame:
    """Sampling parameters per group: the right side's budget is split by the share of major and minor groups."""
    p = pooled.select("p").scalar()
    mix = group_rates.agg(F.avg(F.col("is_major").cast("double")).alias("major_share")).scalar()
    known = group_rates.withColumns({"p2_major": p, "major_share": mix})
    major = F.col("is_major") == 1
    return known.select(
        "grp",
        "is_major",
        "status",
        F.when(major, F.col("p2_major")).otherwise(F.lit(1.0)).alias("p1"),
        F.when(major, F.col("rate") / F.col("p2_major")).otherwise(F.col("rate")).alias("q1"),
        "p2_major",
        (column(e2) * F.col("major_share") / F.col("p2_major")).alias("q2_major"),
        F.lit(1.0).alias("p2_minor"),
        (column(e2) * (1 - F.col("major_share"))).alias("q2_minor"),
    )
