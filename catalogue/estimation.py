"""Estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.common import (
    EVENT_ORDER,
    EVENT_ORDER_ACTUAL,
    LINE_ID,
    event_order_moments,
    event_order_samples,
    event_side,
    line_side,
    literal_rates,
    order_side,
    pair_draws,
)
from catalogue.flagship import sampled_count
from catalogue.planning import _joint_sql
from catalogue.registry import query
from catalogue.sampling import (
    _STRATA,
    fixed_size_ctes,
    group_ctes,
    strata_draws,
    two_level,
    two_level_ctes,
    two_level_draws,
    universe_strata_sample,
)
from thinjoin.functions import predicates
from thinjoin.functions.rates import PRESETS, Rates
from thinjoin.operators import stratified, sweep
from thinjoin.operators import two_level as two_level_module
from thinjoin.operators.estimate import approx_join_agg, average_from_two_pairs, estimates, relative_error
from thinjoin.operators.exact import as_doubles, exact_join_agg
from thinjoin.operators.keystats import key_counts, key_stats
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import Side, sample_pair
from thinjoin.plans import central

_ANY = Rates(1.0, 1.0, 1.0)
_SCALE = "(SELECT 1.0::DOUBLE/(p*q1*q2) FROM r)"
THREE = ("count_estimate", "sum_estimate", "avg_estimate")


@query(
    "e01_sampled_count",
    q.ctes(**EVENT_ORDER, **event_order_samples(q.rates("m", "count", 0.1, 0.1), pair_draws(_ANY, 1, 1)), act=EVENT_ORDER_ACTUAL)
    + f"SELECT replicate, p, q1, q2, count_actual, count_estimate, abs((count_estimate - count_actual)/count_actual) AS relative_error FROM ({q.estimates('t', _SCALE)}), r, act",
    digits=("p", "q1", "q2", "count_estimate", "relative_error"),
)
def sampled_count_query(spark, folder):
    return sampled_count(spark, folder, 0.1)


def _optimal_estimate(name: str, agg: str, seed: int) -> None:
    sql = (
        q.ctes(**EVENT_ORDER, **event_order_samples(q.rates("m", agg, 0.05, 0.02), pair_draws(_ANY, 8, seed)))
        + f"SELECT preset, replicate, {agg}_estimate AS estimate FROM ({q.estimates('t', _SCALE)})"
    )

    @query(name, sql, digits=("estimate",))
    def estimated(spark, folder):
        left, right = event_side(spark, folder), order_side(spark, folder)
        return approx_join_agg(left, right, "cents", agg, 0.05, 0.02, 8, seed)


_optimal_estimate("e01_count_estimate", "count", 201)
_optimal_estimate("e02_sum_estimate", "sum", 202)
_optimal_estimate("e03_avg_estimate", "avg", 203)


@query(
    "e04_avg_from_two_pairs",
    q.ctes(
        **EVENT_ORDER,
        **event_order_samples(q.rates("m", "count", 0.05, 0.05), pair_draws(_ANY, 4, 204)),
        ec=q.estimates("t", _SCALE),
        draws_b=q.draws(pair_draws(_ANY, 4, 205)),
        rb=q.rates("m", "sum", 0.05, 0.05),
        b1=q.sample(q.EVENTS, "user_id", ["event_id"], "left", "(SELECT p FROM rb)", "(SELECT q1 FROM rb)", "user_id, cents", "draws_b"),
        b2=q.sample("orders", "o_custkey", ["o_orderkey"], "right", "(SELECT p FROM rb)", "(SELECT q2 FROM rb)", "o_custkey", "draws_b"),
        tb=q.totals("b1", "b2", "user_id", "o_custkey", "cents"),
        es=q.estimates("tb", "(SELECT 1.0::DOUBLE/(p*q1*q2) FROM rb)", "draws_b"),
    )
    + "SELECT ec.replicate, ec.count_estimate, es.sum_estimate, es.sum_estimate/ec.count_estimate AS avg_estimate FROM ec JOIN es USING (replicate)",
    digits=THREE,
)
def avg_from_two_pairs(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    found = event_order_moments(spark, folder)
    counts = sample_pair(left, right, central.sampling_rates(found, "count", 0.05, 0.05), 4, 204)
    sums = sample_pair(left, right, central.sampling_rates(found, "sum", 0.05, 0.05), 4, 205)
    return average_from_two_pairs(counts, sums, "cents").drop("preset")


_SWEEP = [Rates.preset(p, rate) for p, rate in PRESETS["1%"]]


@query(
    "e05_preset_estimates",
    q.ctes(**event_order_samples("", pair_draws(_SWEEP, 5, 206)))
    + f"SELECT * FROM ({q.estimates('t', '1.0::DOUBLE/(p*q1*q2)')})",
    digits=THREE,
)
def preset_estimates(spark, folder):
    pair = sample_pair(event_side(spark, folder), order_side(spark, folder), _SWEEP, 5, 206)
    return estimates(pair, "cents")


_PRESET = Rates.preset(0.5, 0.1)


def _filtered_totals(where: str) -> dict[str, str]:
    parts = event_order_samples(literal_rates(_PRESET), pair_draws(_ANY, 4, 207))
    parts["t"] = q.totals("s1", "s2", "user_id", "o_custkey", "cents", where=where)
    return parts


@query(
    "e06_filtered_estimates",
    q.ctes(**_filtered_totals("l.event_type <> 'view' AND r.o_orderstatus <> 'P'")) + f"SELECT * FROM ({q.estimates('t', _SCALE)})",
    digits=THREE,
)
def filtered_estimates(spark, folder):
    pair = sample_pair(event_side(spark, folder), order_side(spark, folder), _PRESET, 4, 207)
    left = predicates.compare("event_type", "<>", "view")
    return estimates(pair, "cents", left, predicates.compare("o_orderstatus", "<>", "P"))


def _swept_estimates(op: str, step: int) -> str:
    parts = event_order_samples(literal_rates(_PRESET), pair_draws(_ANY, 3, 208))
    parts["s1"] = q.sample("lineitem", "l_partkey", LINE_ID, "left", "(SELECT p FROM r)", "(SELECT q1 FROM r)", "l_partkey, l_quantity, l_linenumber")
    parts["s2"] = q.sample("lineitem", "l_partkey", LINE_ID, "right", "(SELECT p FROM r)", "(SELECT q2 FROM r)", "l_partkey")
    parts["draws"] = q.draws(pair_draws(_ANY, 3, 208, 4, 4))
    parts.pop("t")
    parts["vals"] = (
        f"SELECT unnest(range(CAST(min(l_quantity) AS BIGINT), CAST(max(l_quantity) AS BIGINT) + 1, {step})) AS value FROM lineitem"
    )
    parts["t"] = (
        "SELECT l.preset, l.replicate, value, CAST(count(*) AS DOUBLE) AS n_join, CAST(sum(l_linenumber) AS DOUBLE) AS s_join, CAST(count(*) AS DOUBLE) AS x_join "
        f"FROM s1 l JOIN s2 r ON l.replicate = r.replicate AND l.l_partkey = r.l_partkey JOIN vals ON l_quantity {op} value GROUP BY 1, 2, 3"
    )
    return (
        q.ctes(**parts)
        + f"SELECT d.preset, d.replicate, vals.value, coalesce(n_join*{_SCALE}, 0.0) AS count_estimate, coalesce(s_join*{_SCALE}, 0.0) AS sum_estimate, "
        "coalesce(s_join/x_join, 0.0) AS avg_estimate FROM draws d CROSS JOIN vals LEFT JOIN t ON t.replicate = d.replicate AND t.value = vals.value"
    )


for _op, _step, _suffix in ((">=", 10, "at_least"), ("=", 5, "equal")):

    @query(f"e06_swept_estimates_{_suffix}", _swept_estimates(_op, _step), digits=THREE)
    def swept_estimates(spark, folder, op=_op, step=_step):
        side = line_side(spark, folder, "l_partkey")
        pair = sample_pair(side, side, _PRESET, 3, 208)
        return sweep.sweep_estimates(pair, side.table, "l_linenumber", "l_quantity", step, op)


@query(
    "e07_joint_estimates",
    q.ctes(**EVENT_ORDER, **event_order_samples(_joint_sql(0.05, 0.05), pair_draws(_ANY, 6, 209)))
    + f"SELECT * FROM ({q.estimates('t', _SCALE)})",
    digits=THREE,
)
def joint_estimates(spark, folder):
    rates = central.joint_rates(event_order_moments(spark, folder), 0.05, 0.05)
    return estimates(sample_pair(event_side(spark, folder), order_side(spark, folder), rates, 6, 209), "cents")


def _group_estimates(draws, classes: str = "is_major IN (0, 1)") -> str:
    """By joining the rows: major groups with the major right sample, minor groups with the minor one."""
    parts = group_ctes(*_STRATA, draws)
    parts["t"] = (
        "SELECT l.replicate, l.event_type AS grp, CAST(count(*) AS DOUBLE) AS n_join, sum(cents) AS s_join FROM s1 l JOIN par ON event_type = par.grp "
        "JOIN s2 r ON l.replicate = r.replicate AND l.user_id = r.o_custkey WHERE CASE WHEN is_major = 1 THEN in_major ELSE in_minor END GROUP BY 1, 2"
    )
    scale = "1.0::DOUBLE/(p1*least(q1, 1.0::DOUBLE)*CASE WHEN is_major = 1 THEN q2_major ELSE q2_minor END)"
    return (
        q.ctes(**parts)
        + f"SELECT d.preset, d.replicate, par.grp, coalesce(n_join*{scale}, 0.0) AS count_estimate, coalesce(s_join*{scale}, 0.0) AS sum_estimate, "
        "coalesce(s_join/n_join, 0.0) AS avg_estimate, n_join IS NOT NULL AS seen, 'ok' AS status FROM draws d CROSS JOIN par "
        f"LEFT JOIN t ON t.replicate = d.replicate AND t.grp = par.grp WHERE {classes}"
    )


@query("e08_universe_strata_estimates", _group_estimates(strata_draws(3, 211)), digits=THREE)
def universe_strata_estimates(spark, folder):
    sample = universe_strata_sample(spark, folder, *_STRATA, 3, 211)
    return stratified.universe_strata_estimates(sample, "cents")


@query("u01_major_and_minor_groups", _group_estimates(strata_draws(2, 212)), digits=THREE)
def major_and_minor_groups(spark, folder):
    """Major and minor groups estimated apart and put together; the classes share no group, so nothing repeats."""
    sample = universe_strata_sample(spark, folder, *_STRATA, 2, 212)
    parts = []
    for is_major in (1, 0):
        chosen = sample.parameters.where(F.col("is_major") == is_major)
        one = stratified.GroupedSample(
            sample.left, sample.right, sample.left_key, sample.right_key, sample.group, chosen, sample.draws
        )
        parts.append(stratified.universe_strata_estimates(one, "cents"))
    return parts[0].unionByName(parts[1])


def _fixed_size_estimates(limit: int, rate: float, draws) -> str:
    parts = fixed_size_ctes(limit, rate, draws)
    parts["t"] = (
        "SELECT l.replicate, l.event_type AS grp, CAST(count(*) AS DOUBLE) AS n_join, sum(cents) AS s_join FROM s1 l "
        "JOIN s2 r ON l.replicate = r.replicate AND l.user_id = r.o_custkey GROUP BY 1, 2"
    )
    r = f"{rate}::DOUBLE"
    scale = f"CASE WHEN n_rows*{r} >= {limit} THEN 1/({r}*{r}) WHEN {limit} >= n_rows THEN 1/{r} ELSE n_rows/{limit}.0::DOUBLE/{r} END"
    return (
        q.ctes(**parts)
        + f"SELECT d.preset, d.replicate, st.grp, coalesce(n_join*({scale}), 0.0) AS count_estimate, coalesce(s_join*({scale}), 0.0) AS sum_estimate, "
        "coalesce(s_join/n_join, 0.0) AS avg_estimate, n_join IS NOT NULL AS seen FROM draws d CROSS JOIN st "
        "LEFT JOIN t ON t.replicate = d.replicate AND t.grp = st.grp"
    )


@query("e09_fixed_size_strata_estimates", _fixed_size_estimates(100, 0.0499, strata_draws(3, 213, ("rank",))), digits=THREE)
def fixed_size_strata_estimates(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    sample = stratified.fixed_size_strata_pair(left, right, "event_type", 100, 0.0499, 3, 213)
    return stratified.fixed_size_strata_estimates(sample, "cents")


@query(
    "e10_two_level_count",
    q.ctes(
        **two_level_ctes(two_level_draws(4, 214)),
        f1="SELECT replicate, user_id AS key, sum(CASE WHEN is_sentry THEN 0 ELSE 1 END) AS f1, max(key_rate) AS p, max(row_rate) AS q FROM s1 GROUP BY 1, 2",
        f2="SELECT replicate, o_custkey AS key, sum(CASE WHEN is_sentry THEN 0 ELSE 1 END) AS f2 FROM s2 GROUP BY 1, 2",
        t="SELECT replicate, sum((1/p)*(f1/q + 1)*(f2/q + 1)) AS total FROM f1 JOIN f2 USING (replicate, key) GROUP BY replicate",
    )
    + "SELECT preset, replicate, coalesce(total, 0.0) AS count_estimate FROM draws LEFT JOIN t USING (replicate)",
    digits=("count_estimate",),
)
def two_level_count(spark, folder):
    return two_level_module.two_level_count(two_level(spark, folder, 4, 214))


# ---------------------------------------------------------------- the evaluated data sets' queries, on the given tables


def _line_order_samples(rates: Rates, replicates: int, seed: int, measure: str) -> dict[str, str]:
    return {
        "draws": q.draws(pair_draws(_ANY, replicates, seed, left_id=4)),
        "r": literal_rates(rates),
        "s1": q.sample("lineitem", "l_orderkey", LINE_ID, "left", "(SELECT p FROM r)", "(SELECT q1 FROM r)", f"l_orderkey, l_linenumber, {measure}"),
        "s2": q.sample("orders", "o_orderkey", ["o_orderkey"], "right", "(SELECT p FROM r)", "(SELECT q2 FROM r)", "o_orderkey, o_orderstatus, o_orderpriority"),
    }


def _line_order_sql(rates: Rates, replicates: int, seed: int, where: str, actual_where: str) -> str:
    parts = _line_order_samples(rates, replicates, seed, "l_quantity")
    parts["t"] = q.totals("s1", "s2", "l_orderkey", "o_orderkey", "l_quantity", where=where)
    parts["act"] = (
        "SELECT CAST(count(*) AS DOUBLE) AS count_actual, sum(l_quantity) AS sum_actual, avg(l_quantity) AS avg_actual "
        f"FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {actual_where}"
    )
    return q.ctes(**parts) + f"SELECT e.*, act.* FROM ({q.estimates('t', _SCALE)}) e, act"


def _with_actual(estimated, actual):
    one = as_doubles(actual).select(F.struct("count_actual", "sum_actual", "avg_actual").alias("a")).scalar()
    return estimated.withColumns({n: one.getField(n) for n in ("count_actual", "sum_actual", "avg_actual")})


_TPCH = Rates.preset(0.1, 0.3)


@query(
    "e11_orders_lines_by_status",
    _line_order_sql(_TPCH, 4, 221, "r.o_orderstatus <> 'P'", "o_orderstatus <> 'P'"),
    digits=(*THREE, "avg_actual"),
)
def orders_lines_by_status(spark, folder):
    """TPC-H shape: line items with orders that are not pending."""
    left, right = line_side(spark, folder), order_side(spark, folder, "o_orderkey")
    where = predicates.compare("o_orderstatus", "<>", "P")
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "l_quantity", right_where=where)
    return _with_actual(estimates(sample_pair(left, right, _TPCH, 4, 221), "l_quantity", right_where=where), actual)


_PRICE = _line_order_samples(_TPCH, 4, 225, "round(l_extendedprice * 100) AS price")
_PRICE["t"] = q.totals("s1", "s2", "l_orderkey", "o_orderkey", "price", where="r.o_orderstatus <> 'P'")


@query(
    "e11_average_price_by_status",
    q.ctes(**_PRICE) + f"SELECT preset, replicate, avg_estimate FROM ({q.estimates('t', _SCALE)})",
    digits=("avg_estimate",),
)
def average_price_by_status(spark, folder):
    """TPC-H shape: average price in cents over orders that are not pending."""
    lines = line_side(spark, folder)
    left = Side(lines.table.withColumn("price", F.round(F.col("l_extendedprice") * 100)), lines.key, lines.row_id)
    pair = sample_pair(left, order_side(spark, folder, "o_orderkey"), _TPCH, 4, 225)
    found = estimates(pair, "price", right_where=predicates.compare("o_orderstatus", "<>", "P"))
    return found.select("preset", "replicate", "avg_estimate")


@query(
    "e11_basket_lines_by_position",
    _line_order_sql(_TPCH, 4, 222, "l.l_linenumber <> 1", "l_linenumber <> 1"),
    digits=(*THREE, "avg_actual"),
)
def basket_lines_by_position(spark, folder):
    """Basket shape: the predicate is on the left table."""
    left, right = line_side(spark, folder), order_side(spark, folder, "o_orderkey")
    where = predicates.compare("l_linenumber", "<>", 1)
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "l_quantity", left_where=where)
    return _with_actual(estimates(sample_pair(left, right, _TPCH, 4, 222), "l_quantity", where), actual)


@query(
    "e11_ratings_without_label",
    _line_order_sql(_TPCH, 4, 223, "r.o_orderpriority NOT LIKE '%HIGH%'", "o_orderpriority NOT LIKE '%HIGH%'"),
    digits=(*THREE, "avg_actual"),
)
def ratings_without_label(spark, folder):
    """Ratings shape: the right table's text column must not hold a word."""
    left, right = line_side(spark, folder), order_side(spark, folder, "o_orderkey")
    where = predicates.lacks_text("o_orderpriority", "HIGH")
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "l_quantity", right_where=where)
    return _with_actual(estimates(sample_pair(left, right, _TPCH, 4, 223), "l_quantity", right_where=where), actual)


@query(
    "e11_optimal_filtered_sum",
    q.ctes(
        ls=q.stats("lineitem", "l_orderkey", "l_quantity", where="l_returnflag <> 'N'"),
        rc=q.counts("orders", "o_orderkey", where="o_orderstatus <> 'P'"),
        m=q.moments(),
        draws=q.draws(pair_draws(_ANY, 3, 224, left_id=4)),
        r=q.rates("m", "sum", 0.1, 0.1),
        s1=q.sample("(SELECT * FROM lineitem WHERE l_returnflag <> 'N')", "l_orderkey", LINE_ID, "left", "(SELECT p FROM r)", "(SELECT q1 FROM r)", "l_orderkey, l_quantity"),
        s2=q.sample("(SELECT * FROM orders WHERE o_orderstatus <> 'P')", "o_orderkey", ["o_orderkey"], "right", "(SELECT p FROM r)", "(SELECT q2 FROM r)", "o_orderkey"),
        t=q.totals("s1", "s2", "l_orderkey", "o_orderkey", "l_quantity"),
    )
    + f"SELECT preset, replicate, sum_estimate AS estimate FROM ({q.estimates('t', _SCALE)})",
    digits=("estimate",),
)
def optimal_filtered_sum(spark, folder):
    """Both predicates hold for planning and for sampling."""
    return approx_join_agg(
        line_side(spark, folder), order_side(spark, folder, "o_orderkey"), "l_quantity", "sum", 0.1, 0.1, 3, 224,
        predicates.compare("l_returnflag", "<>", "N"), predicates.compare("o_orderstatus", "<>", "P"),
    )


@query(
    "e12_relative_errors",
    q.ctes(**event_order_samples("", pair_draws(_SWEEP, 3, 231)), act=EVENT_ORDER_ACTUAL)
    + "SELECT preset, replicate, abs((count_estimate - count_actual)/count_actual) AS count_error, "
    "abs((sum_estimate - sum_actual)/sum_actual) AS sum_error, abs((avg_estimate - avg_actual)/avg_actual) AS avg_error "
    f"FROM ({q.estimates('t', '1.0::DOUBLE/(p*q1*q2)')}), act",
    digits=("count_error", "sum_error", "avg_error"),
)
def relative_errors(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    actual = exact_join_agg(left.table, right.table, left.key, right.key, "cents")
    found = _with_actual(estimates(sample_pair(left, right, _SWEEP, 3, 231), "cents"), actual)
    errors = [
        relative_error(F.col(f"{agg}_estimate"), F.col(f"{agg}_actual")).alias(f"{agg}_error") for agg in ("count", "sum", "avg")
    ]
    return found.select("preset", "replicate", *errors)


@query(
    "e01_self_join_count",
    q.ctes(
        ls=q.stats("lineitem", "l_partkey", "l_quantity"),
        rc=q.counts("lineitem", "l_partkey"),
        m=q.moments(),
        draws=q.draws(pair_draws(_ANY, 3, 232, 4, 4)),
        r=q.rates("m", "count", 0.01, 0.01),
        s1=q.sample("lineitem", "l_partkey", LINE_ID, "left", "(SELECT p FROM r)", "(SELECT q1 FROM r)", "l_partkey, l_quantity"),
        s2=q.sample("lineitem", "l_partkey", LINE_ID, "right", "(SELECT p FROM r)", "(SELECT q2 FROM r)", "l_partkey"),
        t=q.totals("s1", "s2", "l_partkey", "l_partkey", "l_quantity"),
    )
    + f"SELECT preset, replicate, count_estimate, sum_estimate, avg_estimate FROM ({q.estimates('t', _SCALE)})",
    digits=THREE,
)
def self_join_count(spark, folder):
    side = line_side(spark, folder, "l_partkey")
    found = moments(key_stats(side.table, side.key, "l_quantity"), key_counts(side.table, side.key))
    pair = sample_pair(side, side, central.sampling_rates(found, "count", 0.01, 0.01), 3, 232)
    return estimates(pair, "l_quantity")
