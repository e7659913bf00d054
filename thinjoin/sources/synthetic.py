"""Synthetic join tables: ``col1`` key, ``col2`` measure, ``col3`` second measure or predicate, ``col4`` payload.

Rows are computed from a row number (``spark.range``) or from any integral column of an existing table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.functions import variates as v
from thinjoin.operators.keystats import heaviest_key

# The measures' parameters.
MEASURE_RANGE = 1000
MEASURE_EXPONENT = -1.5
WORST_SHARE = 0.75
PAYLOAD_LENGTH = 200


def row_numbers(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "row")


def measure_columns(row: Column, seed: int, measure: str = "powerlaw") -> dict[str, Column]:
    """``col2`` (power law over 1..1000, relabelled, or normal(100, 25) to one decimal) and ``col3`` (1..99)."""
    if measure == "powerlaw":
        drawn = v.power_law(row, seed, "measure", MEASURE_EXPONENT, F.lit(MEASURE_RANGE))
        first = v.relabel(drawn, F.lit(MEASURE_RANGE), seed)
    elif measure == "normal":
        first = F.round(100 + 25 * v.standard_normal(row, seed, "measure"), 1)
    else:
        raise ValueError(f"unknown measure: {measure}")
    return {"col2": first, "col3": v.uniform_int(row, seed, "second", 1, F.lit(99))}


def payload(row: Column) -> Column:
    """200 characters of upper-case letters and digits."""
    return F.substring(F.repeat(F.upper(F.md5(row.cast("string"))), 7), 1, PAYLOAD_LENGTH)


def synthetic_table(
    rows: DataFrame,
    num_keys: Column,
    distribution: str,
    seed: int,
    row: str = "row",
    measure: str = "powerlaw",
    relation: str | None = None,
    predicate_values: int = 100,
    with_payload: bool = False,
) -> DataFrame:
    """One table. With ``relation``, ``col3`` is a predicate column instead of a uniform measure."""
    identity = F.col(row)
    drawn = v.keys(identity, seed, distribution, num_keys)
    columns = {"col1": v.relabel(drawn, num_keys, seed), **measure_columns(identity, seed, measure)}
    if relation is not None:
        columns["col3"] = v.related_value(identity, seed, relation, columns["col1"], num_keys, predicate_values)
    if with_payload:
        columns["col4"] = payload(identity)
    return rows.select(row, *[c.alias(n) for n, c in columns.items()])


def worst_case_table(rows: DataFrame, left: DataFrame, left_key: str, num_keys: Column, seed: int, row: str = "row") -> DataFrame:
    """A right table with three quarters of its rows on the left table's heaviest key, the rest uniform."""
    heaviest = heaviest_key(left, left_key).select("key").scalar()
    identity = F.col(row)
    key = F.when(v.uniform(identity, seed, "worst") < WORST_SHARE, heaviest).otherwise(
        v.uniform_int(identity, seed, "key", 1, num_keys)
    )
    columns = measure_columns(identity, seed)
    return rows.select(row, key.alias("col1"), *[c.alias(n) for n, c in columns.items()])


def write_grid(
    spark: SparkSession, folder: str, rows: int, num_keys: int, distributions: Iterable[str], overwrite: bool = False
) -> list[str]:
    """Both sides of every distribution as Parquet tables; existing ones are kept unless ``overwrite``."""
    written = []
    for distribution in distributions:
        for side in (1, 2):
            path = f"{folder}/{distribution}_{side}"
            table = synthetic_table(row_numbers(spark, rows), F.lit(num_keys), distribution, seed=side).drop("row")
            table.write.mode("overwrite" if overwrite else "ignore").parquet(path)
            written.append(path)
    return written
