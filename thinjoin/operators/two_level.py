"""Two-level samples: a universe rate per key, one sentry row per kept key and Bernoulli rows beside it.

With key rate ``p_v`` and row rate ``q``, a key with ``a`` and ``b`` rows contributes variance ``X / p_v`` and costs
``Y = 2 + q (a + b - 2)`` rows when kept. The variance under a row budget is least at ``p_v`` proportional to
``sqrt(X / Y)``, and then equals ``(sum sqrt(X Y))^2`` over the budget, so ``q`` is the minimiser of that sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY, Draws, coefficients_needed, fine_hash
from thinjoin.operators.keystats import key_counts
from thinjoin.operators.sampling import Side, hash_below
from thinjoin.operators.skew import fits_broadcast, hot_keys, join_by_key
from thinjoin.session import settle

GRID = 32


def spread(q: Column) -> Column:
    """X: a key's variance term at row rate ``q``."""
    a, b = F.col("a"), F.col("b")
    rows = (
        (1 / (q * q) - 1) * (a - 1) * (b - 1)
        + (1 / q - 1) * (b - 1) * (a * a - a + 1)
        + (1 / q - 1) * (a - 1) * (b * b - b + 1)
    )
    return F.greatest(rows, F.lit(0.0)) + a * a * b * b


def cost(q: Column) -> Column:
    """Y: rows expected from a kept key."""
    return 2 + q * (F.col("a") + F.col("b") - 2)


def frequency_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """How many shared keys have each pair of frequencies.

    The search for ``q`` depends on a key only through (a, b), so it runs on this histogram, not on the keys.
    """
    return _pair_counts(key_counts(left, left_key, "a").join(key_counts(right, right_key), "key"))


def _pair_counts(shared: DataFrame) -> DataFrame:
    return shared.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n_keys"))


def _grid_totals(pairs: DataFrame, steps: list[float], rate: Column, least: Column) -> DataFrame:
    """``sum sqrt(X Y)`` at the rates that ``rate`` gives for a literal list of steps, in one aggregate."""
    fanned = pairs.select("a", "b", "n_keys", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    known = fanned.withColumn("q", F.least(F.lit(1.0), F.greatest(least, rate)))
    q = F.col("q")
    return known.groupBy("step", "q").agg(F.sum(F.col("n_keys") * F.sqrt(spread(q) * cost(q))).alias("total"))


def row_rate(pairs: DataFrame, left_rows: DataFrame, budget: float) -> DataFrame:
    """One row: ``q`` and the constant ``c`` of ``p_v``.

    The best rate falls with the frequencies, about as 2 over a key's rows, so rates are searched on a logarithmic grid
    from a quarter of one over the largest pair of frequencies to 1, and then on a finer one around its best. ``c``
    makes the expected sample ``budget`` times the left table's rows; the relation is linear.
    """
    pairs = settle(pairs, "frequency-pairs")
    least = pairs.agg((F.lit(0.25) / F.max(F.col("a") + F.col("b"))).alias("least")).scalar()
    coarse = _grid_totals(pairs, [i / GRID for i in range(GRID + 1)], F.pow(least, F.col("step")), least)
    near = coarse.agg(F.min_by("q", F.struct("total", "q")).alias("q")).scalar()
    around = [i / GRID / GRID for i in range(-GRID, GRID + 1)]
    fine = _grid_totals(pairs, around, near * F.pow(least, F.col("step")), least)
    best = fine.agg(
        F.min_by("q", F.struct("total", "q")).alias("q"),
        F.min("total").alias("total"),
    )
    n = left_rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return best.select("q", "total", F.try_divide(F.lit(float(budget)) * n, F.col("total")).alias("c"))


def key_rates(left: Side, right: Side, budget: float) -> DataFrame:
    """``p`` and ``q`` of every shared key. A key whose ``p`` would pass 1 gets it as extra rows instead."""
    shared = key_counts(left.table, left.key, "a").join(key_counts(right.table, right.key), "key")
    shared = settle(shared, "key-counts")
    chosen = row_rate(_pair_counts(shared), left.table, budget).select(F.struct("q", "c").alias("r")).scalar()
    known = shared.withColumns({"_q": chosen.getField("q"), "_c": chosen.getField("c")})
    raw = known.withColumn("_p", F.col("_c") * F.sqrt(spread(F.col("_q")) / cost(F.col("_q"))))
    x = F.col("a") + F.col("b") - 2
    moved = F.when(x <= 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.try_divide(F.col("_p") * (2 + F.col("_q") * x) - 2, x))
    )
    over = F.col("_p") > 1
    return raw.select(
        "key",
        "a",
        "b",
        F.least(F.col("_p"), F.lit(1.0)).alias("p"),
        F.when(over, moved).otherwise(F.col("_q")).alias("q"),
    )


@dataclass(frozen=True)
class TwoLevelSample:
    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    draws: Draws

    def draw_table(self) -> DataFrame:
        return self.draws.table(self.left.sparkSession)


def two_level_sample(left: Side, right: Side, rates: DataFrame, replicates: int = 1, seed: int = 1) -> TwoLevelSample:
    """Draw both sides. ``rates`` is ``key_rates`` or a stored copy of it. The kept keys are stored, the rows are not."""
    roles = {"key": coefficients_needed(1)}
    for side, name in ((left, "left"), (right, "right")):
        roles[name] = coefficients_needed(len(side.row_id))
        roles[f"{name}_first"] = coefficients_needed(len(side.row_id))
    draws = Draws(seed, tuple(range(1, replicates + 1)), roles)
    fanned, draw = draws.attach(rates.select("key", "p", "q"))
    kept = fanned.where(hash_below(rates, ["key"], "key", draw, F.col("p")))
    kept_keys = kept.select(*DRAW_KEY, F.col("key").alias("_key"), F.col("p").alias("_p"), F.col("q").alias("_q"))
    kept_keys = settle(kept_keys, "kept-keys")
    return TwoLevelSample(
        _two_level_side(left, "left", kept_keys, draws),
        _two_level_side(right, "right", kept_keys, draws),
        left.key,
        right.key,
        draws,
    )


def _two_level_side(side: Side, role: str, kept_keys: DataFrame, draws: Draws) -> DataFrame:
    """Rows of the kept keys that are sentries or pass the row rate, flagged ``is_sentry``.

    The sentry is the row with the smallest 62-bit hash. The minimum per key is combined on the map side, so no key's
    rows are gathered in one place, and the rows are then compared with it as they are read again.
    """
    table = side.table.where(F.col(side.key).isNotNull())
    draw = draws.coefficient
    place = fine_hash(table, side.row_id, f"{role}_first", draw)
    hot = None if fits_broadcast(kept_keys) else hot_keys(table, side.key)
    identity = table.select(side.key, *[c for c in side.row_id if c != side.key])
    members = join_by_key(identity, side.key, kept_keys, "_key", hot)
    sentries = members.groupBy(*DRAW_KEY, "_key", "_p", "_q").agg(F.min(place).alias("_place"))
    rows = join_by_key(table, side.key, settle(sentries, f"{role}-sentries"), "_key", hot)
    is_sentry = place == F.col("_place")
    kept = rows.where(is_sentry | hash_below(table, side.row_id, role, draw, F.col("_q")))
    return kept.select(
        *DRAW_KEY,
        *table.columns,
        F.col("_p").alias("key_rate"),
        F.col("_q").alias("row_rate"),
        is_sentry.alias("is_sentry"),
    )


def two_level_count(sample: TwoLevelSample) -> DataFrame:
    """COUNT per draw: ``(1/p)(f1/q + 1)(f2/q + 1)`` over keys kept on both sides, ``f`` the non-sentry rows."""

    def per_key(df: DataFrame, key: str, name: str) -> DataFrame:
        others = F.sum((~F.col("is_sentry")).cast("double")).alias(name)
        return df.groupBy(*DRAW_KEY, F.col(key).alias("key")).agg(
            others, F.max("key_rate").alias(f"p_{name}"), F.max("row_rate").alias(f"q_{name}")
        )

    left = per_key(sample.left, sample.left_key, "f1")
    right = per_key(sample.right, sample.right_key, "f2").select(*DRAW_KEY, "key", "f2")
    shared = left.join(right, [*DRAW_KEY, "key"])
    rows = (F.col("f1") / F.col("q_f1") + 1) * (F.col("f2") / F.col("q_f1") + 1) / F.col("p_f1")
    met = shared.select(*DRAW_KEY, rows.alias("rows"))
    none = sample.draw_table().select(*DRAW_KEY, F.lit(0.0).alias("rows"))
    return met.unionByName(none).groupBy(*DRAW_KEY).agg(F.sum("rows").alias("count_estimate"))
