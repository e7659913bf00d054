"""Replicated runs and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.common import EVENT_ORDER_ACTUAL, LINE_ID, event_order_samples, event_side, line_side, order_side, pair_draws
from catalogue.registry import query, table
from thinjoin.evaluation import metrics, runs
from thinjoin.functions.rates import PRESETS, Rates
from thinjoin.operators import sweep
from thinjoin.operators.estimate import estimates
from thinjoin.operators.exact import exact_join_agg
from thinjoin.operators.sampling import sample_pair
from thinjoin.session import new_path, settle

_ANY = Rates(1.0, 1.0, 1.0)
SETTINGS = [Rates.preset(p, rate) for p, rate in PRESETS["10%"]]
REPLICATES, SEED = 12, 301
CONFIGURATION = ("query", "left_dist", "right_dist", "preset")

RESULTS = {
    **event_order_samples("", pair_draws(SETTINGS, REPLICATES, SEED)),
    "est": q.estimates("t", "1.0::DOUBLE/(p*q1*q2)"),
    "act": EVENT_ORDER_ACTUAL,
    "res": " UNION ALL ".join(
        f"SELECT preset, replicate AS idx, 'events' AS left_dist, 'orders' AS right_dist, '{agg}' AS query, "
        f"{agg}_actual AS actual, {agg}_estimate AS estimate FROM est, act"
        for agg in runs.AGGREGATES
    ),
}
_GROUP = ", ".join(CONFIGURATION)


def result_rows(spark, folder):
    """COUNT, SUM and AVG of every preset and replicate, drawn in one scan of each table."""
    left, right = event_side(spark, folder), order_side(spark, folder)
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "cents")
    found = estimates(sample_pair(left, right, SETTINGS, REPLICATES, SEED), "cents")
    return runs.results(found, actual, "events", "orders", {})


def stored_results(spark, folder):
    """The result rows as a stored table, as a finished run leaves them."""
    return settle(result_rows(spark, folder), "results")


@query("v01_result_rows", q.ctes(**RESULTS) + "SELECT * FROM res", digits=("actual", "estimate"))
def replicated_runs(spark, folder):
    return result_rows(spark, folder)


@query(
    "v02_missing_runs",
    q.ctes(**RESULTS) + "SELECT query, preset, idx FROM res WHERE idx > 7 OR preset = 5",
)
def missing_runs(spark, folder):
    wanted = stored_results(spark, folder).select("query", "preset", "idx")
    done = wanted.where((F.col("idx") <= 7) & (F.col("preset") != 5))
    return runs.missing_runs(wanted, done, ["query", "preset"])


@query("v02_next_index", q.ctes(**RESULTS) + f"SELECT {_GROUP}, max(idx) + 1 AS next_idx FROM res WHERE idx <= 5 + preset GROUP BY {_GROUP}")
def next_index(spark, folder):
    return runs.next_index(stored_results(spark, folder).where("idx <= 5 + preset"), CONFIGURATION)


@query(
    "v03_variance",
    q.ctes(**RESULTS) + f"SELECT {_GROUP}, var_samp(estimate) AS variance, var_pop(estimate) AS population_variance FROM res GROUP BY {_GROUP}",
    digits=("variance", "population_variance"),
)
def variance(spark, folder):
    grouped = result_rows(spark, folder).groupBy(*CONFIGURATION)
    return grouped.agg(metrics.variance().alias("variance"), metrics.population_variance().alias("population_variance"))


def _metric(name: str, column: str, sql: str, build) -> None:
    @query(name, q.ctes(**RESULTS) + f"SELECT {_GROUP}, {sql} AS {column} FROM res GROUP BY {_GROUP}", digits=(column,))
    def metric(spark, folder):
        return result_rows(spark, folder).groupBy(*CONFIGURATION).agg(build().alias(column))


_metric("v04_spread_over_actual", "ratio", "stddev_samp(estimate)/avg(actual)", metrics.spread_over_actual)
_metric("v05_mean_percent_error", "error", "avg(abs((actual - estimate)/actual)*100)", metrics.mean_percent_error)
_metric(
    "v06_interval_ratio", "ratio", "(1.96::DOUBLE*stddev_samp(estimate)/sqrt(count(*)))/avg(estimate)", metrics.interval_ratio
)


@query(
    "v07_dispersion_with_theory",
    q.ctes(
        **RESULTS,
        ls=q.stats(q.EVENTS, "user_id", "cents"),
        rc=q.counts("orders", "o_custkey"),
        m=q.moments(),
        th=" UNION ALL ".join(
            f"SELECT {i}::INTEGER AS preset, '{agg}' AS query, {q.variance(agg, repr(r.p) + '::DOUBLE', repr(r.p * r.q1) + '::DOUBLE', repr(r.p * r.q2) + '::DOUBLE')} AS theory FROM m"
            for i, r in enumerate(SETTINGS)
            for agg in runs.AGGREGATES
        ),
    )
    + f"SELECT {_GROUP}, var_samp(estimate) AS variance, var_samp(estimate)/avg(estimate) AS vmr, stddev_samp(estimate)/avg(estimate) AS smr, max(theory) AS theory "
    f"FROM res JOIN th USING (preset, query) GROUP BY {_GROUP}",
    digits=("variance", "vmr", "smr", "theory"),
)
def dispersion_with_theory(spark, folder):
    from catalogue.common import event_order_moments
    from thinjoin.plans.central import preset_variances

    measured = metrics.dispersion(result_rows(spark, folder), CONFIGURATION)
    theory = preset_variances(event_order_moments(spark, folder), ["10%"])
    number = F.coalesce(*[F.when((F.col("p") == r.p) & (F.col("q") == r.q1), F.lit(i)) for i, r in enumerate(SETTINGS)])
    pairs = F.array(*[F.struct(F.lit(a).alias("query"), F.col(f"{a}_variance").alias("theory")) for a in runs.AGGREGATES])
    return measured.join(theory.select(number.alias("preset"), F.inline(pairs)), ["preset", "query"])


_SUMMARY = (
    f"SELECT {_GROUP}, count(*) AS n_runs, avg(estimate) AS mean_estimate, var_samp(estimate) AS variance, "
    "stddev_samp(estimate)/avg(actual) AS spread_over_actual, avg(abs((actual - estimate)/actual)*100) AS mean_percent_error, "
    f"(1.96::DOUBLE*stddev_samp(estimate)/sqrt(count(*)))/avg(estimate) AS interval_ratio FROM res GROUP BY {_GROUP}"
)
_SUMMARY_DIGITS = ("mean_estimate", "variance", "spread_over_actual", "mean_percent_error", "interval_ratio")


@query("v08_summary", q.ctes(**RESULTS) + _SUMMARY, digits=_SUMMARY_DIGITS)
def summary(spark, folder):
    return metrics.summary(result_rows(spark, folder), CONFIGURATION)


@query("l01_ordered_summary", q.ctes(**RESULTS) + _SUMMARY + f" ORDER BY {_GROUP}", digits=_SUMMARY_DIGITS)
def ordered_summary(spark, folder):
    return metrics.summary(result_rows(spark, folder), CONFIGURATION).orderBy(*CONFIGURATION)


@query(
    "l02_newest_row",
    "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
)
def newest_row(spark, folder):
    rows = table(spark, folder, "events")
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1).select("event_id", "user_id", "event_type")


_PART = Rates.preset(0.3, 0.3)
_PART_DRAWS = pair_draws(_ANY, 5, 302, 4, 4)
_SWEPT = {
    "draws": q.draws(_PART_DRAWS),
    "s1": q.sample("lineitem", "l_partkey", LINE_ID, "left", "0.3::DOUBLE", "0.3::DOUBLE", "l_partkey, l_quantity"),
    "s2": q.sample("lineitem", "l_partkey", LINE_ID, "right", "0.3::DOUBLE", "0.3::DOUBLE", "l_partkey"),
    "t": "SELECT l.replicate, CAST(l_quantity AS BIGINT) AS value, CAST(count(*) AS DOUBLE) AS n FROM s1 l JOIN s2 r ON l.replicate = r.replicate "
    "AND l.l_partkey = r.l_partkey GROUP BY 1, 2",
    "vals": "SELECT unnest(range(CAST(min(l_quantity) AS BIGINT), CAST(max(l_quantity) AS BIGINT) + 1, 5)) AS value FROM lineitem",
    "e": "SELECT replicate, value, coalesce(n/(0.3::DOUBLE*0.3::DOUBLE*0.3::DOUBLE), 0) AS estimate FROM draws CROSS JOIN vals LEFT JOIN t USING (replicate, value)",
    "w": "SELECT CAST(l_quantity AS BIGINT) AS value, count(*)/(SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS weight FROM lineitem GROUP BY 1",
    "pv": "SELECT value, var_pop(estimate) AS v FROM e GROUP BY value",
}


@query(
    "v09_predicate_weighted_variance",
    q.ctes(**_SWEPT) + "SELECT 'count' AS query, avg(v) AS mean_variance, sum(v*weight) AS weighted_variance FROM pv JOIN w USING (value)",
    digits=("mean_variance", "weighted_variance"),
)
def predicate_weighted_variance(spark, folder):
    side = line_side(spark, folder, "l_partkey")
    pair = sample_pair(side, side, _PART, 5, 302)
    found = sweep.sweep_estimates(pair, side.table, "l_linenumber", "l_quantity", 5, "=")
    rows = found.select(F.lit("count").alias("query"), "value", F.col("count_estimate").alias("estimate"))
    weights = sweep.sweep_weights(side.table, "l_quantity", 5, "=")
    return metrics.predicate_weighted_variance(rows, weights, ["query"])


@query(
    "v10_variance_matrix",
    q.ctes(**RESULTS) + f"SELECT query, {', '.join(f's{i}' for i in range(len(SETTINGS)))} FROM (SELECT query, "
    + ", ".join(f"var_pop(estimate) FILTER (WHERE preset = {i}) AS s{i}" for i in range(len(SETTINGS)))
    + " FROM res GROUP BY query)",
    digits=tuple(f"s{i}" for i in range(len(SETTINGS))),
)
def variance_matrix(spark, folder):
    matrix = metrics.variance_matrix(result_rows(spark, folder), ["query"], "preset", range(len(SETTINGS)))
    return matrix.withColumnsRenamed({str(i): f"s{i}" for i in range(len(SETTINGS))})


@query("v11_merged_results", q.ctes(**RESULTS) + "SELECT query, preset, idx, estimate FROM res", digits=("estimate",))
def merged_results(spark, folder):
    """An interrupted run's rows overlap the stored ones; the merge has each run once."""
    rows = stored_results(spark, folder).select("query", "preset", "idx", "estimate")
    return runs.merged_results(rows.where("idx <= 8"), rows.where("idx >= 4"), ["query", "preset", "idx"])


@query("j06_rows_not_stored", q.ctes(**RESULTS) + "SELECT query, preset, idx, estimate FROM res WHERE idx > 8", digits=("estimate",))
def rows_not_stored(spark, folder):
    rows = stored_results(spark, folder).select("query", "preset", "idx", "estimate")
    return runs.not_in(rows.where("idx >= 4"), rows.where("idx <= 8"), ["query", "preset", "idx"])


@query("u02_appended_results", q.ctes(**RESULTS) + "SELECT query, preset, idx, actual, estimate FROM res", digits=("actual", "estimate"))
def appended_results(spark, folder):
    path = new_path(spark, "results")
    rows = stored_results(spark, folder)
    for part in ("idx <= 6", "idx > 6"):
        runs.append_results(rows.where(part), path, CONFIGURATION)
    return runs.result_table(path, CONFIGURATION).read(spark).select("query", "preset", "idx", "actual", "estimate")


_FIRST = "PARTITION BY query ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(
    "v12_convergence",
    q.ctes(
        **RESULTS,
        one=f"SELECT query, idx, var_samp(estimate) OVER ({_FIRST}) AS first_variance FROM res WHERE preset = 2",
        two=f"SELECT query, idx, var_samp(estimate) OVER ({_FIRST}) AS second_variance FROM res WHERE preset = 5",
    )
    + "SELECT query, idx, first_variance, second_variance, abs((first_variance - second_variance)/nullif(first_variance, 0)) AS relative_gap "
    "FROM one JOIN two USING (query, idx)",
    digits=("first_variance", "second_variance", "relative_gap"),
)
def convergence(spark, folder):
    rows = stored_results(spark, folder)
    return metrics.convergence(rows.where("preset = 2"), rows.where("preset = 5"), ["query"])
