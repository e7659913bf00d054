"""Replicated runs: exact answer beside the estimate of every draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY, Draws
from thinjoin.operators.exact import as_doubles
from thinjoin.sources.committed import CommittedTable
from thinjoin.sources.tables import not_in

AGGREGATES = ("count", "sum", "avg")


def results(
    estimated: DataFrame,
    actual: DataFrame,
    left_name: str,
    right_name: str,
    rates: dict[str, Column],
    by: Sequence[str] = (),
    draws: Draws | None = None,
) -> DataFrame:
    """Long form: one row per (aggregate, draw, ``by`` value) with the rates, the exact answer and the estimate.

    ``actual`` holds one row, or one row per ``by`` value. With ``by``, every answer has a row in each of ``draws``, the
    NULL group included: one without an estimate is kept with 0, and an estimate that is NULL stays NULL.
    """
    actual = as_doubles(actual)
    if by:
        if draws is None:
            raise ValueError("grouped results need the draws, so that answers no draw has met are kept")
        mine = {c: f"_by_{c}" for c in by}
        known = {agg: F.col(f"{agg}_actual") for agg in AGGREGATES}
        every = actual.select(*by, *known.values(), F.inline(draws.identities()).alias(*DRAW_KEY))
        found = estimated.withColumnsRenamed(mine | {c: f"_{c}" for c in DRAW_KEY}).withColumn("_met", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(mine[c])) for c in by] + [F.col(c) == F.col(f"_{c}") for c in DRAW_KEY]
        joined = every.join(found, same, "left")
        guess = {agg: F.when(F.col("_met"), F.col(f"{agg}_estimate")).otherwise(F.lit(0.0)) for agg in AGGREGATES}
    else:
        joined = estimated
        one = actual.select(F.struct(*[f"{agg}_actual" for agg in AGGREGATES]).alias("a")).scalar()
        known = {agg: one.getField(f"{agg}_actual") for agg in AGGREGATES}
        guess = {agg: F.col(f"{agg}_estimate") for agg in AGGREGATES}
    rows = F.array(
        *[
            F.struct(F.lit(agg).alias("query"), known[agg].alias("actual"), guess[agg].alias("estimate"))
            for agg in AGGREGATES
        ]
    )
    return joined.select(
        F.col("preset"),
        F.col("replicate").alias("idx"),
        *by,
        F.lit(left_name).alias("left_dist"),
        F.lit(right_name).alias("right_dist"),
        *[c.alias(n) for n, c in rates.items()],
        F.inline(rows),
    )


def missing_runs(requested: DataFrame, done: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """Requested (configuration, idx) rows that have no result yet."""
    return not_in(requested, done, [*configuration, "idx"])


def next_index(done: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """First replicate to run for each configuration."""
    return done.groupBy(*configuration).agg((F.max("idx") + 1).alias("next_idx"))


def merged_results(stored: DataFrame, pending: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored results plus the pending rows that are not among them."""
    return stored.unionByName(not_in(pending, stored, keys))


def result_table(path: str, configuration: Sequence[str]) -> CommittedTable:
    """The result table under ``path``: each (configuration, idx) stands there once."""
    return CommittedTable(path, (*configuration, "idx"))


def append_results(rows: DataFrame, path: str, configuration: Sequence[str]) -> None:
    """Append the (configuration, idx) that are not there yet, with the time of the run; can be repeated."""
    result_table(path, configuration).add(rows.withColumn("ts", F.current_timestamp()), rows)


def requested_runs(draws: DataFrame) -> DataFrame:
    return draws.select("preset", F.col("replicate").alias("idx")) if set(DRAW_KEY) <= set(draws.columns) else draws
