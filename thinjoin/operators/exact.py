"""Exact answers, aggregated below the join.

``COUNT`` of a many-to-many join is the sum over keys of left rows times right rows, and ``SUM`` the sum of left sums
times right rows. Aggregating each side first keeps the work linear in the tables however hot a key is; the joined
rows are never built.

Counts are whole numbers and their products DECIMAL(38, 0), so that no join is too large to be counted exactly. Sums of
whole and decimal measures stay in decimals; sums of floating-point measures are as exact as those are. AVG is a DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.DecimalType(19, 0)
TOTALS = {"a": "n_join", "x": "x_join", "s": "s_join"}


def exact_stats(df: DataFrame, key: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (``by``, key): rows ``a``, rows with a measure ``x`` and its sum ``s``, all exact."""
    kind = df.schema[measure].dataType
    value = F.col(measure)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = value.cast(ROWS)
    elif not isinstance(kind, T.DecimalType):
        value = value.cast("double")
    sums = [F.count(F.lit(1)).alias("a"), F.count(value).alias("x"), F.sum(value).alias("s")]
    return df.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("key")).agg(*sums)


def exact_counts(df: DataFrame, key: str, name: str = "b") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(name))


def joined_sums(shared: DataFrame) -> list[Column]:
    """Joined rows, joined rows with a measure and the measure's sum, from statistics of both sides; NULL over nothing."""
    of = {"a": F.col("a").cast(ROWS), "x": F.col("x").cast(ROWS), "s": F.col("s")}
    exact = isinstance(shared.schema["s"].dataType, T.DecimalType)
    times = {"a": F.col("b").cast(ROWS), "x": F.col("b").cast(ROWS), "s": F.col("b").cast(ROWS if exact else "double")}
    return [F.sum(of[c] * times[c]).alias(n) for c, n in TOTALS.items()]


def join_totals(left: DataFrame, right: DataFrame, left_key: str, right_key: str, measure: str, by: tuple = ()) -> DataFrame:
    """Joined rows, joined rows with a measure, and the measure's sum."""
    shared = exact_stats(left, left_key, measure, by).join(exact_counts(right, right_key), "key")
    sums = joined_sums(shared)
    totals = shared.groupBy(*by).agg(*sums) if by else shared.agg(*sums)
    return totals.fillna(0, list(TOTALS.values()))


def answers() -> dict[str, Column]:
    return {
        "count_actual": F.col("n_join"),
        "sum_actual": F.col("s_join"),
        "avg_actual": F.coalesce(F.try_divide(F.col("s_join").cast("double"), F.col("x_join").cast("double")), F.lit(0.0)),
    }


def exact_join_agg(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    measure: str,
    by: str | None = None,
    left_where: Column | None = None,
    right_where: Column | None = None,
) -> DataFrame:
    """COUNT, SUM and AVG of ``measure`` over the equi-join, optionally filtered and grouped.

    COUNT is a DECIMAL(38, 0), SUM a decimal too unless the measure is a floating-point number, AVG a DOUBLE.
    """
    left = left if left_where is None else left.where(left_where)
    right = right if right_where is None else right.where(right_where)
    grouping = (by,) if by else ()
    totals = join_totals(left, right, left_key, right_key, measure, grouping)
    return totals.select(*grouping, *[c.alias(n) for n, c in answers().items()])


def join_size(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Number of joined rows from the two key frequencies, as a DECIMAL(38, 0)."""
    shared = exact_counts(left, left_key, "a").join(exact_counts(right, right_key), "key")
    rows = F.sum(F.col("a").cast(ROWS) * F.col("b").cast(ROWS))
    return shared.agg(F.coalesce(rows, F.lit(0)).alias("n_join"))


def as_doubles(actual: DataFrame) -> DataFrame:
    """Answers as DOUBLE, to be compared with estimates."""
    return actual.withColumns({n: F.col(n).cast("double") for n in answers() if n in actual.columns})
