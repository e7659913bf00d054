"""Error of preset and optimal samples on synthetic pairs; prints one Markdown row per pair, aggregate and setting.

    python experiments.py [rows] [keys] [replicates]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from thinjoin import Rates, estimates, exact_join_agg, key_counts, key_stats, moments, sample_pair
from thinjoin.evaluation import metrics, runs
from thinjoin.functions.rates import PRESETS
from thinjoin.operators.sampling import Side
from thinjoin.plans.central import sampling_rates
from thinjoin.session import local_session, settle
from thinjoin.sources.synthetic import row_numbers, synthetic_table

PAIRS = (("uniform", "uniform"), ("uniform", "normal"), ("normal", "normal"), ("normal", "powerlaw"), ("powerlaw", "powerlaw"))
BUDGET = 0.01


def main() -> None:
    rows, keys, replicates = (int(v) for v in (*sys.argv[1:], *("1000000", "100000", "100")[len(sys.argv) - 1 :]))
    spark = local_session(name="thinjoin-experiments")
    spark.sparkContext.setLogLevel("ERROR")
    names = sorted({(d, side) for pair in PAIRS for side, d in enumerate(pair, start=1)})
    tables = {
        (d, side): Side(settle(synthetic_table(row_numbers(spark, rows), F.lit(keys), d, seed=40 + side), f"{d}-{side}"), "col1", ("row",))
        for d, side in names
    }
    print("| T1 | T2 | aggregate | setting | p | spread / actual | mean abs. % error | 95 % half-width / mean |")
    print("|---|---|---|---|---|---|---|---|")
    for left_name, right_name in PAIRS:
        left, right = tables[left_name, 1], tables[right_name, 2]
        actual = exact_join_agg(left.table, right.table, "col1", "col1", "col2")
        found = settle(moments(key_stats(left.table, "col1", "col2"), key_counts(right.table, "col1")), "moments")
        settings = [Rates.preset(p, q) for p, q in PRESETS["1%"]]
        for agg in runs.AGGREGATES:
            row = sampling_rates(found, agg, BUDGET, BUDGET).first()
            settings.append(Rates(row["p"], row["q1"], row["q2"]))
        measured = runs.results(estimates(sample_pair(left, right, settings, replicates, 9), "col2"), actual, left_name, right_name, {})
        summary = metrics.summary(measured, ["query", "preset"]).orderBy("query", "preset").collect()
        for r in summary:
            optimal = r["preset"] - len(PRESETS["1%"])
            if optimal >= 0 and runs.AGGREGATES[optimal] != r["query"]:
                continue
            label = "optimal" if optimal >= 0 else f"preset {r['preset'] + 1}"
            figures = (settings[r["preset"]].p, r["spread_over_actual"], r["mean_percent_error"], r["interval_ratio"])
            shown = " | ".join("" if v is None else f"{v:.4g}" for v in figures)
            print(f"| {left_name} | {right_name} | {r['query']} | {label} | {shown} |", flush=True)


if __name__ == "__main__":
    main()
