"""The flagship query: a sampled COUNT of a many-to-many join, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.common import event_order_moments, event_side, order_side
from thinjoin.operators.estimate import estimates, relative_error
from thinjoin.operators.exact import exact_join_agg
from thinjoin.operators.sampling import sample_pair
from thinjoin.plans.central import sampling_rates


def sampled_count(spark: SparkSession, folder: str, budget: float) -> DataFrame:
    left, right = event_side(spark, folder), order_side(spark, folder)
    rates = sampling_rates(event_order_moments(spark, folder), "count", budget, budget)
    pair = sample_pair(left, right, rates)
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "cents").select(F.col("count_actual").cast("double")).scalar()
    estimated = estimates(pair, "cents").select("replicate", "count_estimate", actual.alias("count_actual"))
    error = relative_error(F.col("count_estimate"), F.col("count_actual"))
    rates = pair.rates
    return estimated.select(
        "replicate", F.lit(rates.p).alias("p"), F.lit(rates.q1).alias("q1"), F.lit(rates.q2).alias("q2"),
        "count_actual", "count_estimate", error.alias("relative_error"),
    )
