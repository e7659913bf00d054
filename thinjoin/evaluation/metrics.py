"""Error metrics over a result table (``query``, configuration, ``idx``, ``actual``, ``estimate``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: normal quantile of a 95 % interval.
Z95 = 1.96


def variance() -> Column:
    return F.var_samp("estimate")


def population_variance() -> Column:
    return F.var_pop("estimate")


def spread_over_actual() -> Column:
    return F.try_divide(F.stddev_samp("estimate"), F.avg("actual"))


def mean_percent_error() -> Column:
    return F.avg(F.abs(F.try_divide(F.col("actual") - F.col("estimate"), F.col("actual"))) * 100)


def interval_ratio() -> Column:
    """Half-width of the 95 % interval of the mean, over the mean."""
    half = F.lit(Z95) * F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))
    return F.try_divide(half, F.avg("estimate"))


def variance_to_mean() -> Column:
    return F.try_divide(F.var_samp("estimate"), F.avg("estimate"))


def spread_to_mean() -> Column:
    return F.try_divide(F.stddev_samp("estimate"), F.avg("estimate"))


def metric_columns() -> list[Column]:
    return [
        F.count("estimate").alias("n_runs"),
        F.avg("estimate").alias("mean_estimate"),
        variance().alias("variance"),
        spread_over_actual().alias("spread_over_actual"),
        mean_percent_error().alias("mean_percent_error"),
        interval_ratio().alias("interval_ratio"),
    ]


def summary(results: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """All metrics per configuration in one pass."""
    return results.groupBy(*configuration).agg(*metric_columns())


def dispersion(results: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """Variance-to-mean and spread-to-mean ratios per configuration."""
    return results.groupBy(*configuration).agg(
        variance().alias("variance"), variance_to_mean().alias("vmr"), spread_to_mean().alias("smr")
    )


def predicate_weighted_variance(results: DataFrame, weights: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """Variances per predicate value, averaged over the values and weighted by their frequency."""
    per_value = results.groupBy(*configuration, "value").agg(population_variance().alias("v"))
    known = per_value.join(weights.select("value", "weight"), "value")
    return known.groupBy(*configuration).agg(
        F.avg("v").alias("mean_variance"), F.sum(F.col("v") * F.col("weight")).alias("weighted_variance")
    )


def variance_matrix(results: DataFrame, rows: Sequence[str], setting: str, settings: Sequence) -> DataFrame:
    """Variances with one column per setting; the settings are given, so no extra job looks for them."""
    return results.groupBy(*rows).pivot(setting, list(settings)).agg(population_variance())


def running_variance(results: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """Variance of the first i replicates of each configuration; a partition holds one configuration's runs."""
    first = Window.partitionBy(*configuration).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return results.select(*configuration, "idx", F.var_samp("estimate").over(first).alias("variance"))


def convergence(first: DataFrame, second: DataFrame, configuration: Sequence[str]) -> DataFrame:
    """Relative difference of two methods' running variances."""
    one = running_variance(first, configuration).withColumnRenamed("variance", "first_variance")
    two = running_variance(second, configuration).withColumnRenamed("variance", "second_variance")
    gap = F.abs(F.try_divide(F.col("first_variance") - F.col("second_variance"), F.col("first_variance")))
    return one.join(two, [*configuration, "idx"]).withColumn("relative_gap", gap)
