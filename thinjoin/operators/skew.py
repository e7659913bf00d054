"""Joining a large table to a per-key table when some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.session import settle

# Keys with more than 1/1000 of the rows are hot. There are fewer than 1000 of them, whatever the data.
HOT_KEYS = 1000


def fits_broadcast(stored: DataFrame, limit: int | None = None) -> bool:
    """Whether a stored table's size in bytes, as Spark's planner reads it off its files, allows a broadcast."""
    plan = stored._jdf.queryExecution().optimizedPlan()
    if limit is None:
        limit = stored.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(plan.stats().sizeInBytes())) <= limit


def hot_keys(big: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than 1/1000 of the rows, stored."""
    counts = big.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    rows = big.select(F.count(F.lit(1)).alias("n")).scalar()
    return settle(counts.where(F.col("_n") * HOT_KEYS > rows).select("_hot_key"), "hot-keys")


def join_by_key(
    big: DataFrame,
    key: str,
    small: DataFrame,
    small_key: str,
    hot: DataFrame | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Inner join of ``big`` with ``small``, a stored table with few rows per key.

    A table whose stored size is within ``broadcast_bytes`` (Spark's own ``spark.sql.autoBroadcastJoinThreshold`` unless
    given) is joined as Spark sees fit, which is by broadcast. Otherwise the rows of hot keys (``hot_keys``, unless
    given) meet a broadcast of the hot keys' entries where they are and are never shuffled; only the other rows, none
    of whose keys weighs more than a thousandth, are shuffled by key. No task receives a hot key.
    """

    def same(frame_key: str) -> Column:
        return F.col(key).eqNullSafe(F.col(frame_key))

    if fits_broadcast(small, broadcast_bytes):
        return big.join(small, same(small_key))
    hot = F.broadcast(hot_keys(big, key) if hot is None else hot)
    is_hot = F.col(small_key).eqNullSafe(F.col("_hot_key"))
    hot_small, cold_small = small.join(hot, is_hot, "left_semi"), small.join(hot, is_hot, "left_anti")
    cold_big = big.join(hot, same("_hot_key"), "left_anti")
    return big.join(F.broadcast(hot_small), same(small_key)).unionByName(cold_big.join(cold_small, same(small_key)))
