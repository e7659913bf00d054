"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the fastest counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.common import event_side, line_side, order_side
from catalogue.registry import QUERIES
from thinjoin import Rates, estimates, exact_join_agg, key_counts, key_stats, moments, sample_pair
from thinjoin.operators.sampling import SamplePair, Side
from thinjoin.plans.central import sampling_rates
from thinjoin.session import local_session, new_path
from thinjoin.sources import catalog

BUDGET = 0.01
MEASURES = {"event_order": "cents", "line_order": "l_quantity", "part_self": "l_quantity"}
REGISTERED = (
    "a08_moments", "n05_decentral_sum_rate", "n09_predicate_rate_count_at_least_identical", "n14_two_level_parameters",
    "s03_preset_sweep", "s09_two_level_left", "e05_preset_estimates", "e06_swept_estimates_at_least",
    "e08_universe_strata_estimates", "e09_fixed_size_strata_estimates", "e10_two_level_count", "v08_summary",
)


def pairs(spark: SparkSession, folder: str) -> dict[str, tuple[Side, Side]]:
    part = line_side(spark, folder, "l_partkey")
    return {
        "event_order": (event_side(spark, folder), order_side(spark, folder)),
        "line_order": (line_side(spark, folder), order_side(spark, folder, "o_orderkey")),
        "part_self": (part, part),
    }


def naive(left: Side, right: Side, measure: str) -> DataFrame:
    """The join as written, rows and all."""
    one = left.table.select(F.col(left.key).alias("k"), F.col(measure).alias("x"))
    two = right.table.select(F.col(right.key).alias("k"))
    return one.join(two, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.avg("x").alias("m"))


def planned(left: Side, right: Side, measure: str) -> DataFrame:
    found = moments(key_stats(left.table, left.key, measure), key_counts(right.table, right.key))
    return sampling_rates(found, "count", BUDGET, BUDGET)


def timed(run, runs: int):
    best, value = float("inf"), None
    for _ in range(runs):
        start = time.perf_counter()
        value = run()
        best = min(best, time.perf_counter() - start)
    return round(best, 4), value


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "thinjoin-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds: dict[str, float] = {}
    errors: dict[str, float] = {}
    for name, (left, right) in pairs(spark, folder).items():
        measure = MEASURES[name]
        seconds[f"naive_{name}"], _ = timed(lambda: naive(left, right, measure).collect(), runs)
        seconds[f"exact_{name}"], actual = timed(
            lambda: exact_join_agg(left.table, right.table, left.key, right.key, measure).first(), runs
        )
        seconds[f"plan_{name}"], rates = timed(lambda: planned(left, right, measure).first(), runs)
        fixed = Rates(rates["p"], rates["q1"], rates["q2"])

        def build(left: Side = left, right: Side = right, fixed: Rates = fixed) -> SamplePair:
            path = new_path(spark, "bench-sample")
            pair = sample_pair(left, right, fixed)
            catalog.write_sample(pair.left, f"{path}/left")
            catalog.write_sample(pair.right, f"{path}/right")
            stored = [spark.read.parquet(f"{path}/{side}") for side in ("left", "right")]
            return SamplePair(*stored, left.key, right.key, fixed, pair.draws)

        seconds[f"sample_{name}"], pair = timed(build, runs)
        seconds[f"estimate_{name}"], row = timed(lambda: estimates(pair, measure).first(), runs)
        errors[name] = round(abs(row["count_estimate"] / float(actual["count_actual"]) - 1), 5)

    for name in REGISTERED:
        seconds[name], _ = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save(), runs)

    report = {
        "metric": "total seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "relative_error": errors,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
