"""Universe-then-Bernoulli sample pairs.

A key is kept with probability ``p`` by a hash shared by both sides, then each row of a kept key with probability
``q1`` (left) or ``q2`` (right) by a hash of the row's identity, independent between the sides. All replicates and
all presets are drawn in one scan of each table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from thinjoin.functions.hashing import DRAW_KEY, Draws, coefficients_needed, comparison_type, fine_hash, limit_of
from thinjoin.functions.rates import Rates

RateSource = Rates | Sequence[Rates]


@dataclass(frozen=True)
class Side:
    """A table in a pair: its join key and the columns that tell its rows apart.

    ``row_id`` must be unique, since rows with equal identity are kept or dropped together. Parquet tables without
    such columns get one from ``sources.tables.with_row_id``.
    """

    table: DataFrame
    key: str
    row_id: tuple[str, ...]


@dataclass(frozen=True)
class SamplePair:
    """Samples of both sides with their draw columns, and the rates behind them."""

    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    rates: RateSource
    draws: Draws = field(repr=False)

    def draw_table(self) -> DataFrame:
        return self.draws.table(self.left.sparkSession)


def fixed_rates(rates: RateSource | DataFrame) -> RateSource:
    """A planner's one-row DataFrame as literal rates; literal rates unchanged.

    Planning ends in one row of three numbers. Reading it here runs the planning job once, and the sampling jobs then
    test against constants instead of carrying the planning plan in every filter.
    """
    if not isinstance(rates, DataFrame):
        return rates
    row = rates.first()
    if row is None or row["p"] is None:
        reason = row["status"] if row is not None and "status" in row else "no plan"
        raise ValueError(f"no sampling rate: {reason}")
    return Rates(row["p"], row["q1"], row["q2"])


def rate_columns(rates: RateSource) -> dict[str, Column] | None:
    """Rates as literals; ``None`` when they vary by preset."""
    if isinstance(rates, Rates):
        return {"p": F.lit(rates.p), "q1": F.lit(rates.q1), "q2": F.lit(rates.q2)}
    return None


def make_draws(rates: RateSource, replicates: int | Sequence[int], seed: int, roles: Mapping[str, int]) -> Draws:
    numbers = tuple(range(1, replicates + 1)) if isinstance(replicates, int) else tuple(replicates)
    if isinstance(rates, Rates):
        return Draws(seed, numbers, roles)
    return Draws(seed, numbers, roles, tuple({"p": r.p, "q1": r.q1, "q2": r.q2} for r in rates))


def hash_below(
    df: DataFrame, columns: Sequence[str], role: str, draw, rate: Column, as_type: DataType | None = None
) -> Column:
    """True for rows whose 62-bit hash under ``role`` falls below the rate.

    31 bits alone would keep 1.4 times a rate of 1e-9. The hash stands in the condition once: written out again for
    rows at the border, it made scans of two hashes too long for the JVM to compile.
    """
    return fine_hash(df, columns, role, draw, as_type) < limit_of(rate)


def sample_side(
    side: Side, role: str, rate: str, rates: RateSource, draws: Draws, key_type: DataType | None = None
) -> DataFrame:
    """The sample of one side: all its columns plus ``preset`` and ``replicate``."""
    present = side.table.where(F.col(side.key).isNotNull())
    fanned, draw = draws.attach(present)
    columns = rate_columns(rates) or {name: draw(name) for name in ("p", "q1", "q2")}
    kept = fanned.where(
        hash_below(present, [side.key], "key", draw, columns["p"], key_type)
        & hash_below(present, side.row_id, role, draw, columns[rate])
    )
    return kept.select(*DRAW_KEY, *side.table.columns)


def pair_draws(left: Side, right: Side, rates: RateSource, replicates: int | Sequence[int], seed: int) -> Draws:
    """The draws of a pair: one key hash for both sides, one row hash per side."""
    roles = {
        "key": coefficients_needed(1),
        "left": coefficients_needed(len(left.row_id)),
        "right": coefficients_needed(len(right.row_id)),
    }
    return make_draws(rates, replicates, seed, roles)


def sample_pair(
    left: Side, right: Side, rates: RateSource | DataFrame, replicates: int | Sequence[int] = 1, seed: int = 1
) -> SamplePair:
    """Draw a pair. ``rates`` is literal, a sequence of presets, or a planner's one-row DataFrame.

    Keys of different types are hashed in the type in which the join compares them.
    """
    key_type = comparison_type(left.table, left.key, right.table, right.key)
    rates = fixed_rates(rates)
    draws = pair_draws(left, right, rates, replicates, seed)
    return SamplePair(
        sample_side(left, "left", "q1", rates, draws, key_type),
        sample_side(right, "right", "q2", rates, draws, key_type),
        left.key,
        right.key,
        rates,
        draws,
    )


def universe_sample(side: Side, p: float, replicates: int | Sequence[int] = 1, seed: int = 1) -> DataFrame:
    """Universe sampling alone: every row of a kept key."""
    draws = make_draws(Rates(p, 1.0, 1.0), replicates, seed, {"key": coefficients_needed(1)})
    present = side.table.where(F.col(side.key).isNotNull())
    fanned, draw = draws.attach(present)
    kept = fanned.where(hash_below(present, [side.key], "key", draw, F.lit(p)))
    return kept.select(*DRAW_KEY, *side.table.columns)


def bernoulli_sample(side: Side, q: float, replicates: int | Sequence[int] = 1, seed: int = 1, role: str = "left") -> DataFrame:
    """Bernoulli sampling alone, by row identity."""
    draws = make_draws(Rates(1.0, q, q), replicates, seed, {role: coefficients_needed(len(side.row_id))})
    fanned, draw = draws.attach(side.table)
    kept = fanned.where(hash_below(side.table, side.row_id, role, draw, F.lit(q)))
    return kept.select(*DRAW_KEY, *side.table.columns)


def joined_samples(pair: SamplePair) -> DataFrame:
    """The joined sample rows themselves. Aggregates should use ``estimates``, which never builds them."""
    right = pair.right.withColumnRenamed(pair.right_key, pair.left_key)
    return pair.left.join(right, [*DRAW_KEY, pair.left_key])
