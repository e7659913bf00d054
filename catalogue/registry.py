"""Registration of a query together with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def significant(column: Column) -> Column:
    """Ten significant digits: sums of doubles differ in the last bits with the order of addition."""
    return F.when(column.isNotNull(), F.format_string("%.9e", column * F.lit(q.NUDGE)).cast("double"))


def query(name: str, sql: str | None = None, digits: Sequence[str] = ()):
    """Register a query. ``digits`` names the real-valued columns that both sides round before they are compared."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            found = build(spark, folder)
            return found.withColumns({c: significant(F.col(c)) for c in digits}) if digits else found

        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = q.significant(sql, digits)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the measure in whole cents, so that sums are exact."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).alias("cents")
    )
