"""Many values of one predicate at once: ``column = v`` or ``column >= v`` for v from min to max by a step.

Rows are assigned to the largest swept value they satisfy and aggregated once. For ``>=`` the answer at ``v`` then
is the running total over the slots from the top down to ``v``, so a sweep of n values costs one pass over the data,
not n, and rows are never multiplied by the values they satisfy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY
from thinjoin.operators.estimate import estimate_columns, sample_key_stats, scale_factor
from thinjoin.operators.exact import answers, exact_counts, exact_stats, joined_sums
from thinjoin.operators.keystats import key_counts, key_stats
from thinjoin.operators.moments import MOMENTS, column_terms, moment_terms
from thinjoin.operators.sampling import SamplePair

TOTALS = ("n_join", "x_join", "s_join")
#: Swept values that one task accumulates; a sweep of 10^9 values has some 15,000 blocks.
BLOCK = 1 << 16


def sweep_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: integer bounds of the predicate column."""
    return df.agg(F.min(column).cast("long").alias("low"), F.max(column).cast("long").alias("high"))


def sweep_values(bounds: DataFrame, step: int) -> DataFrame:
    """(block, value): the swept values, ``BLOCK`` to a block. As many rows as the range has steps, whatever the table
    size; blocks are dealt out before their values are made, so no task makes them all."""
    width = BLOCK * step
    blocks = bounds.select("low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / width))).alias("block"))
    first = F.col("low") + F.col("block") * width
    last = F.least(F.col("high"), first + (width - step))
    return blocks.repartition("block").select("block", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("value"))


def with_slot(df: DataFrame, column: str, bounds: DataFrame, step: int, op: str) -> DataFrame:
    """Add ``_slot``: the largest swept value the row satisfies (``>=``), or the one it equals (``=``)."""
    low = bounds.select("low").scalar()
    slot = low + F.floor((F.col(column) - low) / step).cast("long") * step
    slotted = df.where(F.col(column).isNotNull()).withColumn("_slot", slot)
    if op == ">=":
        return slotted
    if op == "=":
        return slotted.where(F.col(column) == F.col("_slot"))
    raise ValueError(f"unsupported sweep: {op}")


def _slot_stats(df: DataFrame, key: str, measure: str, column: str, bounds: DataFrame, step: int, op: str) -> DataFrame:
    slotted = with_slot(df, column, bounds, step, op)
    return key_stats(slotted, key, measure, ["_slot"]).withColumnRenamed("_slot", "value")


def _downward(*partition: str):
    """Running window from the highest swept value down; its partitions hold one row per value of a block or a key."""
    return Window.partitionBy(*partition).orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _above(every: DataFrame, names: Sequence[str], draws: Sequence[str]) -> DataFrame:
    """Per (draw, block), the sums over all higher blocks: a scan over the blocks' sums, one row per block."""
    sums = every.groupBy(*draws, "block").agg(*[F.sum(n).alias(n) for n in names])
    higher = Window.partitionBy(*draws, F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.sum(n).over(higher), F.lit(0)).alias(f"_{n}_above") for n in names]
    return sums.select(*draws, "block", *above)


def _complete(values: DataFrame, sums: DataFrame, names: Sequence[str], op: str, draws: Sequence[str] = ()) -> DataFrame:
    """Every swept value (0 where no row has it), accumulated downwards for ``>=``: within its block, and from the
    blocks above."""
    joined = values.join(sums, [*draws, "value"], "left")
    every = joined.select(*draws, "block", "value", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    if op == "=":
        return every.drop("block")
    running = _downward(*draws, "block")
    within = every.select(*draws, "block", "value", *[F.sum(n).over(running).alias(n) for n in names])
    whole = within.join(_above(every, names, draws), [*draws, "block"])
    return whole.select(*draws, "value", *[(F.col(n) + F.col(f"_{n}_above")).alias(n) for n in names])


def sweep_key_stats(left: DataFrame, key: str, measure: str, column: str, step: int, op: str) -> DataFrame:
    """Per (value, key) statistics. For ``>=`` a row appears at each slot where the key's total changes."""
    stats = _slot_stats(left, key, measure, column, sweep_bounds(left, column), step, op)
    if op == "=":
        return stats
    running = _downward("key")
    return stats.select("value", "key", *[F.sum(c).over(running).alias(c) for c in "axsq"])


def sweep_moments(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, column: str, step: int, op: str
) -> DataFrame:
    """Moments of the filtered join at every swept value.

    For ``>=`` a key's statistics are a step function of the value; each slot contributes the change of the moment
    term there, and the running total over slots restores the moments.
    """
    bounds = sweep_bounds(left, column)
    stats = _slot_stats(left, left_key, measure, column, bounds, step, op)
    if op == ">=":
        running = _downward("key")
        stats = stats.withColumns({f"{c}_to": F.sum(c).over(running) for c in "axsq"})
    shared = stats.join(key_counts(right, right_key), "key")
    if op == "=":
        changes = column_terms()
    else:
        after = [F.col(f"{c}_to") for c in "axsq"]
        before = [F.col(f"{c}_to") - F.col(c) for c in "axsq"]
        high, low = moment_terms(*after, F.col("b")), moment_terms(*before, F.col("b"))
        changes = {name: high[name] - low[name] for name in MOMENTS}
    sums = shared.groupBy("value").agg(*[F.sum(change).alias(name) for name, change in changes.items()])
    return _complete(sweep_values(bounds, step), sums, MOMENTS, op)


def sweep_weights(left: DataFrame, column: str, step: int, op: str) -> DataFrame:
    """Share of the left table's rows that satisfy the predicate at each swept value."""
    bounds = sweep_bounds(left, column)
    slotted = with_slot(left, column, bounds, step, op)
    slots = slotted.groupBy(F.col("_slot").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    total = left.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return _complete(sweep_values(bounds, step), slots, ["n_rows"], op).withColumn("weight", F.col("n_rows") / total)


def sweep_answers(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, column: str, step: int, op: str
) -> DataFrame:
    """Exact COUNT, SUM and AVG at every swept value."""
    bounds = sweep_bounds(left, column)
    slotted = with_slot(left, column, bounds, step, op).withColumnRenamed("_slot", "value")
    shared = exact_stats(slotted, left_key, measure, ["value"]).join(exact_counts(right, right_key), "key")
    sums = shared.groupBy("value").agg(*joined_sums(shared))
    totals = _complete(sweep_values(bounds, step), sums, TOTALS, op)
    return totals.select("value", *[c.alias(n) for n, c in answers().items()])


def _slot_totals(shared: DataFrame, by: Sequence[str]) -> DataFrame:
    b = F.col("b")
    return shared.groupBy(*by).agg(*[F.sum(F.col(c) * b).alias(n) for c, n in zip("axs", TOTALS, strict=True)])


def sweep_estimates(pair: SamplePair, base: DataFrame, measure: str, column: str, step: int, op: str) -> DataFrame:
    """Estimates at every swept value for every draw; the values come from the unsampled table ``base``."""
    bounds = sweep_bounds(base, column)
    slotted = with_slot(pair.left, column, bounds, step, op)
    left = sample_key_stats(slotted, pair.left_key, measure, ["_slot"]).withColumnRenamed("_slot", "value")
    right = sample_key_stats(pair.right, pair.right_key, None).withColumnRenamed("a", "b")
    sums = _slot_totals(left.join(right, [*DRAW_KEY, "key"]), [*DRAW_KEY, "value"])
    every = sweep_values(bounds, step).select("block", "value", F.inline(pair.draws.identities()).alias(*DRAW_KEY))
    totals = _complete(every, sums, TOTALS, op, DRAW_KEY)
    columns: dict[str, Column] = estimate_columns(scale_factor(pair.rates))
    return totals.select(*DRAW_KEY, "value", *[c.alias(n) for n, c in columns.items()])


def fill_down(stats: DataFrame, bounds: DataFrame, step: int) -> DataFrame:
    """Per-key running statistics at every swept value, not only where they change.

    A key's statistics hold from one slot down to the next lower slot the key has. The result has one row per (value, key) the
    predicate keeps; planners and estimators work on the slots themselves and do not need it.
    """
    low = bounds.select("low").scalar()
    below = F.lead("value").over(Window.partitionBy("key").orderBy(F.col("value").desc()))
    held = stats.withColumn("_from", F.coalesce(below + step, low))
    steps = F.sequence(F.col("_from"), F.col("value"), F.lit(step).cast("long"))
    return held.select(F.explode(steps).alias("value"), "key", *"axsq")
