"""Answers and estimates under one predicate with a list of values: ``column = v`` or ``column >= v``.

A row goes to the slot of the largest listed value that it reaches, so it is aggregated once whatever the number of
values; running totals over the slots then give every value's answer. The list is meant for up to a few hundred values: a
row is compared with each. Regular steps over a column's whole range are in ``sweep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY
from thinjoin.operators.estimate import estimate_columns, sample_key_stats, scale_factor
from thinjoin.operators.exact import TOTALS, answers, exact_counts, exact_stats, joined_sums
from thinjoin.operators.sampling import SamplePair


def _listed(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in sorted(set(values))])


def slotted(df: DataFrame, column: str, op: str, values: Sequence[int]) -> DataFrame:
    """``df`` with ``_slot``: the number of the largest listed value that the row reaches or equals, from 1; others go."""
    tested = F.col(column)
    if op == ">=":
        slot = F.size(F.filter(_listed(values), lambda v: tested >= v))
    elif op == "=":
        slot = F.size(F.filter(_listed(values), lambda v: tested >= v)) * F.exists(_listed(values), lambda v: tested == v).cast("int")
    else:
        raise ValueError(f"unsupported predicate: {op}")
    return df.where(tested.isNotNull()).withColumn("_slot", slot).where(F.col("_slot") > 0)


def _by_value(sums: DataFrame, op: str, values: Sequence[int], every: DataFrame, by: Sequence[str]) -> DataFrame:
    """(``by``, cond_val, totals) of every listed value from the slots' sums; ``every`` has the ``by`` rows wanted."""
    listed = every.select(*by, F.posexplode(_listed(values)).alias("_at", "cond_val"))
    slots = listed.select(*by, (F.col("_at") + 1).alias("_slot"), "cond_val")
    filled = slots.join(sums, [*by, "_slot"], "left").fillna(0, list(TOTALS.values()))
    if op == "=":
        return filled.drop("_slot")
    # a row per listed value in a partition, and nothing else
    downward = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*by, "cond_val", *[F.sum(n).over(downward).alias(n) for n in TOTALS.values()])


def filtered_answers(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, column: str, op: str, values: Sequence[int]
) -> DataFrame:
    """(cond_val, exact COUNT, SUM and AVG) under the predicate on the left table, for every listed value."""
    stats = exact_stats(slotted(left, column, op, values), left_key, measure, ["_slot"])
    shared = stats.join(exact_counts(right, right_key), "key")
    sums = shared.groupBy("_slot").agg(*joined_sums(shared))
    found = _by_value(sums, op, values, left.sparkSession.range(1).select(), ())
    return found.select("cond_val", *[c.alias(n) for n, c in answers().items()])


def filtered_estimates(pair: SamplePair, measure: str, column: str, op: str, values: Sequence[int]) -> DataFrame:
    """(draw, cond_val, estimates) under the predicate, for every draw of the pair and every listed value."""
    left = sample_key_stats(slotted(pair.left, column, op, values), pair.left_key, measure, ["_slot"])
    right = sample_key_stats(pair.right, pair.right_key, None).withColumnRenamed("a", "b")
    shared = left.join(right, [*DRAW_KEY, "key"])
    met = [F.sum(F.col(c) * F.col("b")).alias(n) for c, n in TOTALS.items()]
    sums = shared.groupBy(*DRAW_KEY, "_slot").agg(*met)
    found = _by_value(sums, op, values, pair.draw_table().select(*DRAW_KEY), DRAW_KEY)
    return found.select(*DRAW_KEY, "cond_val", *[c.alias(n) for n, c in estimate_columns(scale_factor(pair.rates)).items()])
