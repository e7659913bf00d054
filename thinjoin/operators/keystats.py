"""Per-key statistics of a table.

All of these are plain ``groupBy`` aggregates with map-side combination, so a key that holds a third of the rows
costs one partial row per task. Squares are kept as doubles because squared counts of hot keys exceed 64 bits.

Columns: ``key``, ``a`` rows, ``x`` rows with a measure, ``s`` sum of the measure, ``q`` sum of its squares.
NULL keys never join and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str, name: str = "b") -> DataFrame:
    """Rows per key."""
    counted = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    return counted.agg(F.count(F.lit(1)).cast("double").alias(name))


def stat_columns(measure: str | Column | None) -> list[Column]:
    """The aggregates behind ``a``, ``x``, ``s`` and ``q``."""
    rows = F.count(F.lit(1)).cast("double").alias("a")
    if measure is None:
        return [rows]
    value = (F.col(measure) if isinstance(measure, str) else measure).cast("double")
    return [
        rows,
        F.count(value).cast("double").alias("x"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(value * value), F.lit(0.0)).alias("q"),
    ]


def key_stats(df: DataFrame, key: str, measure: str | None, by: Sequence[str] = ()) -> DataFrame:
    """``a``, ``x``, ``s``, ``q`` per key, or per (``by``, key) in the same single pass."""
    keyed = df.where(F.col(key).isNotNull())
    return keyed.groupBy(*by, F.col(key).alias("key")).agg(*stat_columns(measure))


def key_stats_two(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Statistics of two measures at once: ``x1``, ``s1``, ``q1``, ``x2``, ``s2``, ``q2`` beside ``a``."""
    one, two = stat_columns(first), stat_columns(second)
    named = [one[0]]
    named += [c.alias(f"{n}1") for c, n in zip(one[1:], "xsq", strict=True)]
    named += [c.alias(f"{n}2") for c, n in zip(two[1:], "xsq", strict=True)]
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*named)


def key_mean_variance(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Rows, mean and sample variance per key; a single-row key has variance 0, not NULL."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("a"),
        F.avg(measure).alias("mean"),
        F.coalesce(F.var_samp(measure), F.lit(0.0)).alias("variance"),
    )


def key_means(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Mean of the measure per key."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(measure).alias("mean"))


def heaviest_key(df: DataFrame, key: str) -> DataFrame:
    """One row: the largest key frequency and the key that has it (the smallest such key on ties)."""
    counts = key_counts(df, key, "a")
    top = counts.agg(F.max("a").alias("rows"), F.min_by("key", F.struct(-F.col("a"), F.col("key"))).alias("key"))
    return top.select("key", "rows")


def group_profile(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows and distinct keys per group."""
    return df.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"), F.countDistinct(key).cast("double").alias("n_keys")
    )


def column_profile(df: DataFrame, column: str, key: str, group: str) -> DataFrame:
    """One row: bounds of a predicate column and of the key, row count, number of groups."""
    return df.agg(
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
        F.max(key).alias("max_key"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(group).alias("n_groups"),
    )


def value_weights(df: DataFrame, column: str) -> DataFrame:
    """Share of the rows that hold each value of a column."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return counts.select("value", "n_rows", (F.col("n_rows") / total).alias("weight"))
