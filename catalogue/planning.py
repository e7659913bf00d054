"""Rate planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.common import EVENT_ORDER, LINE_ORDER, PART, event_order_moments, line_order_moments, part_moments
from catalogue.registry import events, query, table
from catalogue.statistics import bucketed_ctes, SKETCHES, sketch_ctes
from thinjoin.functions.rates import PRESETS, VARIANCES
from thinjoin.operators import keystats, sketches, stratified, sweep, two_level
from thinjoin.operators.moments import moments
from thinjoin.plans import central, decentral, strata
from thinjoin.sources import synthetic

RATE_COLUMNS = ("p", "q1", "q2")
_CENTRAL = {
    "count": "n01_count_rate",
    "sum": "n02_sum_rate",
    "avg": "n03_avg_rate",
}


def _central(agg: str, name: str) -> None:
    for suffix, ctes, build in (
        ("", EVENT_ORDER, event_order_moments),
        ("_one_to_many", LINE_ORDER, line_order_moments),
        ("_self_join", PART, part_moments),
    ):
        sql = q.ctes(**ctes) + f"SELECT '{agg}' AS agg, p, q1, q2 FROM ({q.rates('m', agg, 0.01, 0.01)})"

        @query(name + suffix, sql, digits=RATE_COLUMNS)
        def planned(spark, folder, build=build):
            return central.sampling_rates(build(spark, folder), agg, 0.01, 0.01).select("agg", *RATE_COLUMNS)


for _agg, _name in _CENTRAL.items():
    _central(_agg, _name)


@query(
    "n03_avg_rate_uneven_budget",
    q.ctes(**EVENT_ORDER) + f"SELECT val1, val2, p, q1, q2 FROM ({q.rates('m', 'avg', 0.02, 0.005)})",
    digits=("val1", "val2", *RATE_COLUMNS),
)
def avg_rate_uneven(spark, folder):
    planned = central.sampling_rates(event_order_moments(spark, folder), "avg", 0.02, 0.005)
    return planned.select("val1", "val2", *RATE_COLUMNS)


_STARS = {"la": q.counts("events", "user_id", "a"), "rb": q.counts("orders", "o_custkey")}
_DEC_COUNT = (
    "SELECT a_star, b_star, p, 0.01::DOUBLE/p AS q1, 0.01::DOUBLE/p AS q2 FROM (SELECT *, least(1.0::DOUBLE, "
    "greatest(0.01::DOUBLE, sqrt(0.01::DOUBLE*0.01::DOUBLE*(a_star*b_star - a_star - b_star + 1)))) AS p FROM "
)


@query(
    "n04_decentral_count_rate",
    q.ctes(**_STARS) + _DEC_COUNT + "(SELECT (SELECT max(a) FROM la) AS a_star, (SELECT max(b) FROM rb) AS b_star))",
    digits=RATE_COLUMNS,
)
def decentral_count(spark, folder):
    left = decentral.side_maximum(keystats.key_counts(table(spark, folder, "events"), "user_id", "a"), "a")
    right = decentral.side_maximum(keystats.key_counts(table(spark, folder, "orders"), "o_custkey"), "b")
    return decentral.count_rates(left, right, 0.01, 0.01)


@query(
    "n04_decentral_count_rate_worst_case",
    q.ctes(**_STARS)
    + _DEC_COUNT
    + "(SELECT (SELECT max(a) FROM la) AS a_star, CAST(floor(count(*)*0.75) AS DOUBLE) AS b_star FROM orders))",
    digits=RATE_COLUMNS,
)
def decentral_count_worst(spark, folder):
    left = decentral.side_maximum(keystats.key_counts(table(spark, folder, "events"), "user_id", "a"), "a")
    return decentral.count_rates(left, decentral.worst_case_frequency(table(spark, folder, "orders")), 0.01, 0.01)


def _dec_sum_sql(stats: str, rows: str, e1: float, e2: float) -> str:
    """Independent form: evaluate both worst keys' variances at every candidate."""
    low = f"{max(e1, e2)}::DOUBLE"

    def h(s2: str, qq: str, p: str) -> str:
        return (
            f"((1.0/{p} - 1)*{s2}*n*n + (1.0/{e2}::DOUBLE - 1.0/{p})*{s2}*n + (1.0/{e1}::DOUBLE - 1.0/{p})*{qq}*n*n "
            f"+ ({p}/({e1}::DOUBLE*{e2}::DOUBLE) - 1.0/{e1}::DOUBLE - 1.0/{e2}::DOUBLE + 1.0/{p})*{qq}*n)"
        )

    def own(s2: str, qq: str) -> str:
        return f"least(1.0::DOUBLE, greatest({low}, sqrt(greatest(0.0::DOUBLE, {e1}::DOUBLE*{e2}::DOUBLE*({s2}*n*n - {s2}*n - {qq}*n*n + {qq}*n)/({qq}*n)))))"

    return (
        q.ctes(
            ls=stats,
            u="SELECT s*s AS s2u, q AS qu FROM ls ORDER BY s*s DESC, q DESC LIMIT 1",
            v="SELECT s*s AS s2v, q AS qv FROM ls ORDER BY q DESC, s*s DESC LIMIT 1",
            k=f"SELECT *, (SELECT CAST(count(*) AS DOUBLE) FROM {rows}) AS n FROM u, v",
            c=f"SELECT *, (qu - qv)*n/({e1}::DOUBLE*{e2}::DOUBLE) AS c2, (s2u - s2v)*n/{e2}::DOUBLE + (qu - qv)*n*n/{e1}::DOUBLE "
            f"- (1.0/{e1}::DOUBLE + 1.0/{e2}::DOUBLE)*(qu - qv)*n - (s2u - s2v)*n*n AS c1, "
            "(qu - qv)*n + (s2u - s2v)*n*n - (s2u - s2v)*n - (qu - qv)*n*n AS c0 FROM k",
            cand="SELECT *, (-c1 - sqrt(c1*c1 - 4*c2*c0))/(2*c2) AS p FROM c WHERE c2 <> 0 AND c1*c1 - 4*c2*c0 >= 0 "
            "UNION ALL SELECT *, (-c1 + sqrt(c1*c1 - 4*c2*c0))/(2*c2) FROM c WHERE c2 <> 0 AND c1*c1 - 4*c2*c0 >= 0 "
            "UNION ALL SELECT *, -c0/c1 FROM c WHERE c2 = 0 AND c1 <> 0 "
            f"UNION ALL SELECT *, {own('s2u', 'qu')} FROM c UNION ALL SELECT *, {own('s2v', 'qv')} FROM c "
            f"UNION ALL SELECT *, {low} FROM c",
            f=f"SELECT p, greatest({h('s2u', 'qu', 'p')}, {h('s2v', 'qv', 'p')}) AS worst FROM cand WHERE p >= {low} AND p <= 1",
        )
        + f"SELECT p, {e1}::DOUBLE/p AS q1, {e2}::DOUBLE/p AS q2, worst FROM f ORDER BY worst, p LIMIT 1"
    )


@query(
    "n05_decentral_sum_rate",
    _dec_sum_sql(q.stats(q.EVENTS, "user_id", "cents"), "orders", 0.0001, 0.0001),
    digits=(*RATE_COLUMNS, "worst"),
)
def decentral_sum(spark, folder):
    stats = keystats.key_stats(events(spark, folder), "user_id", "cents")
    return decentral.sum_rates(stats, table(spark, folder, "orders"), 0.0001, 0.0001).select(*RATE_COLUMNS, "worst")


@query(
    "n05_decentral_sum_rate_signed_measure",
    _dec_sum_sql(q.stats("lineitem", "l_partkey", "(l_quantity - 25)"), "lineitem", 0.0002, 0.0001),
    digits=(*RATE_COLUMNS, "worst"),
)
def decentral_sum_signed(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_partkey", (F.col("l_quantity") - 25).alias("centred"))
    stats = keystats.key_stats(rows, "l_partkey", "centred")
    return decentral.sum_rates(stats, rows, 0.0002, 0.0001).select(*RATE_COLUMNS, "worst")


@query(
    "n06_sketched_avg_rate",
    q.ctes(**sketch_ctes()) + f"SELECT val1, val2, p FROM ({q.rates('m', 'avg', 0.01, 0.01)})",
    digits=("val1", "val2", "p"),
)
def sketched_avg_rate(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    estimated = sketches.sketched_moments(left, right, SKETCHES, seed=3)
    return central.sampling_rates(estimated, "avg", 0.01, 0.01).select("val1", "val2", "p")


@query(
    "n06_bucketed_avg_rate",
    q.ctes(**bucketed_ctes(2000)) + f"SELECT val1, val2, p FROM ({q.rates('m', 'avg', 0.01, 0.01)})",
    digits=("val1", "val2", "p"),
)
def bucketed_avg_rate(spark, folder):
    """The rate from ten thousand counters."""
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    estimated = sketches.bucketed_moments(left, right, 2000, seed=4)
    return central.sampling_rates(estimated, "avg", 0.01, 0.01).select("val1", "val2", "p")


_AVG_RATE = q.rates("m", "avg", 0.01, 0.01)


@query(
    "a16_exact_and_sketched_avg_rate",
    q.ctes(**sketch_ctes(), em=q.moments(), er=_AVG_RATE.replace("FROM m)", "FROM em)"), sr=_AVG_RATE)
    + "SELECT er.val1, er.val2, er.p, sr.val1 AS val1_sketched, sr.val2 AS val2_sketched, sr.p AS p_sketched FROM er, sr",
    digits=("val1", "val2", "p", "val1_sketched", "val2_sketched", "p_sketched"),
)
def exact_and_sketched_avg_rate(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    estimated = sketches.sketched_moments(left, right, SKETCHES, seed=3)
    return central.exact_and_sketched_rates(moments(left, right), estimated, 0.01, 0.01)


def _worst_case_rate_sql() -> str:
    from catalogue.generation import u

    return (
        q.ctes(
            ls=q.stats(q.EVENTS, "user_id", "cents"),
            h="SELECT key FROM ls ORDER BY a DESC, key LIMIT 1",
            w=f"SELECT CASE WHEN {u('worst', seed=5)} < 0.75 THEN (SELECT key FROM h) ELSE "
            f"CAST(floor({u('key', seed=5)}*(SELECT max(user_id) + 1 FROM events)) AS BIGINT) + 1 END AS col1 FROM orders",
            rc=q.counts("w", "col1"),
            m=q.moments(),
        )
        + f"SELECT 'avg' AS agg, p, q1, q2, 'ok' AS status FROM ({q.rates('m', 'avg', 0.01, 0.01)})"
    )


@query("n07_decentral_avg_rate_worst_case", _worst_case_rate_sql(), digits=RATE_COLUMNS)
def decentral_avg(spark, folder):
    left, rows = events(spark, folder), table(spark, folder, "orders").select("o_orderkey")
    keys = left.agg((F.max("user_id") + 1).alias("n")).scalar()
    worst = synthetic.worst_case_table(rows, left, "user_id", keys, seed=5, row="o_orderkey")
    counts = keystats.key_counts(worst, "col1")
    planned = decentral.avg_rates(keystats.key_stats(left, "user_id", "cents"), counts, 0.01, 0.01)
    return planned.select("agg", *RATE_COLUMNS, "status")


def _joint_sql(e1: float, e2: float) -> str:
    answers = {"count": "ab", "sum": "sb", "avg": "(sb/xb)"}
    parts = [q.objective(agg, e1, e2) for agg in answers]
    val1 = " + ".join(f"({p[0]})/({a}*{a})" for p, a in zip(parts, answers.values(), strict=True))
    val2 = " + ".join(f"({p[1]})/({a}*{a})" for p, a in zip(parts, answers.values(), strict=True))
    return q.rates_from(f"SELECT {val1} AS val1, {val2} AS val2 FROM m", e1, e2)


@query(
    "n08_joint_rate",
    q.ctes(**EVENT_ORDER) + f"SELECT val1, val2, p, q1, q2 FROM ({_joint_sql(0.01, 0.01)})",
    digits=("val1", "val2", *RATE_COLUMNS),
)
def joint_rate(spark, folder):
    return central.joint_rates(event_order_moments(spark, folder), 0.01, 0.01).select("val1", "val2", *RATE_COLUMNS)


def _swept(step: int, op: str) -> dict[str, str]:
    """Moments of the part self join for every swept l_quantity, by filtering once per value."""
    return {
        "vals": "SELECT unnest(range(CAST(min(l_quantity) AS BIGINT), CAST(max(l_quantity) AS BIGINT) + 1, "
        f"{step})) AS value FROM lineitem",
        "ls": "SELECT value, l_partkey AS key, CAST(count(*) AS DOUBLE) AS a, CAST(count(l_linenumber) AS DOUBLE) AS x, "
        "CAST(sum(l_linenumber) AS DOUBLE) AS s, CAST(sum(l_linenumber*l_linenumber) AS DOUBLE) AS q "
        f"FROM vals JOIN lineitem ON l_quantity {op} value GROUP BY value, l_partkey",
        "rc": q.counts("lineitem", "l_partkey"),
        "m": q.moments(by=["value"]),
        "w": f"SELECT value, count(*)/(SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS weight FROM vals JOIN lineitem ON l_quantity {op} value GROUP BY value",
    }


def _predicate_rate(agg: str, op: str, weighted: bool, name: str) -> None:
    step = 5 if op == "=" else 10
    val1, val2 = q.objective(agg, 0.01, 0.01)
    share = "weight*" if weighted else ""
    pooled = f"SELECT sum({share}({val1})) AS val1, sum({share}({val2})) AS val2 FROM m JOIN w USING (value)"
    sql = q.ctes(**_swept(step, op)) + f"SELECT val1, val2, p, q1, q2 FROM ({q.rates_from(pooled, 0.01, 0.01)})"

    @query(name, sql, digits=("val1", "val2", *RATE_COLUMNS))
    def planned(spark, folder):
        rows = table(spark, folder, "lineitem")
        swept = sweep.sweep_moments(rows, rows, "l_partkey", "l_partkey", "l_linenumber", "l_quantity", step, op)
        weight = None
        if weighted:
            weights = sweep.sweep_weights(rows, "l_quantity", step, op).select("value", "weight")
            swept, weight = swept.join(weights, "value"), F.col("weight")
        found = central.pooled_rates(swept, agg, 0.01, 0.01, weight)
        return found.select("val1", "val2", *RATE_COLUMNS)


_predicate_rate("count", "=", False, "n09_predicate_rate_count_equal_uniform")
_predicate_rate("count", ">=", True, "n09_predicate_rate_count_at_least_identical")
_predicate_rate("sum", ">=", False, "n09_predicate_rate_sum_at_least_uniform")
_predicate_rate("avg", "=", True, "n09_predicate_rate_avg_equal_identical")


@query(
    "a08_swept_moments",
    q.ctes(**_swept(10, ">=")) + "SELECT * FROM m",
)
def swept_moments(spark, folder):
    rows = table(spark, folder, "lineitem")
    return sweep.sweep_moments(rows, rows, "l_partkey", "l_partkey", "l_linenumber", "l_quantity", 10, ">=")


# ---------------------------------------------------------------- groups

GROUPS = {
    "ls": q.stats(q.EVENTS, "user_id", "cents", ["event_type"]),
    "rc": q.counts("orders", "o_custkey"),
    "m": q.moments(by=["event_type"]),
}


def pooled_sql(agg: str, e1: float, e2: float) -> str:
    val1, val2 = q.objective(agg, e1, e2)
    return q.rates_from(f"SELECT sum({val1}) AS val1, sum({val2}) AS val2 FROM m", e1, e2)


def group_moments(spark, folder):
    stats = keystats.key_stats(events(spark, folder), "user_id", "cents", ["event_type"])
    return moments(stats, keystats.key_counts(table(spark, folder, "orders"), "o_custkey"), ["event_type"])


for _agg in ("count", "sum", "avg"):

    @query(
        f"n10_grouped_rate_{_agg}",
        q.ctes(**GROUPS) + f"SELECT val1, val2, p, q1, q2 FROM ({pooled_sql(_agg, 0.05, 0.02)})",
        digits=("val1", "val2", *RATE_COLUMNS),
    )
    def grouped_rate(spark, folder, agg=_agg):
        found = central.pooled_rates(group_moments(spark, folder), agg, 0.05, 0.02)
        return found.select("val1", "val2", *RATE_COLUMNS)


PROFILE = (
    "SELECT o_orderpriority AS grp, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n_keys "
    "FROM orders GROUP BY o_orderpriority"
)
# A threshold inside the spread of the groups' key counts, so that both classes occur at every scale.
KEY_T_SQL = "(SELECT avg(n_keys) FROM prof)"


def _profile(spark, folder):
    profile = keystats.group_profile(table(spark, folder, "orders"), "o_orderpriority", "o_custkey")
    return profile, profile.agg(F.avg("n_keys").alias("t")).first()["t"]


@query(
    "n11_proportional_group_rates",
    q.ctes(
        prof=PROFILE,
        g=f"SELECT *, CAST(n_keys >= {KEY_T_SQL} AS INTEGER) AS is_major FROM prof",
        c="SELECT is_major, CAST(count(*) AS DOUBLE) AS k, sum(n_rows) AS n FROM g GROUP BY is_major",
    )
    + "SELECT grp, n_rows, n_keys, is_major, CASE WHEN 20*k <= 0.05::DOUBLE*n THEN 20.0::DOUBLE/n_rows + (0.05::DOUBLE*n - 20*k)/n END AS rate, "
    "CASE WHEN 20*k <= 0.05::DOUBLE*n THEN 'ok' ELSE 'budget exceeded' END AS status FROM g JOIN c USING (is_major)",
    digits=("rate",),
)
def proportional_group_rates(spark, folder):
    profile, key_t = _profile(spark, folder)
    return strata.proportional_rates(profile, key_t, 20, 0.05)


@query(
    "n12_rebalanced_group_rates",
    q.ctes(
        prof="SELECT o_custkey AS grp, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS n_keys "
        "FROM orders GROUP BY o_custkey",
        g="SELECT *, CAST(n_keys >= 3 AS INTEGER) AS is_major, n_rows*(0.4::DOUBLE/2) >= 2 AS enough FROM prof",
        t="SELECT sum(CASE WHEN enough THEN n_rows*(0.4::DOUBLE/2) ELSE 0 END)/sum(CASE WHEN enough THEN 0 ELSE 1 END) AS share FROM g",
    )
    + "SELECT grp, n_rows, n_keys, is_major, CASE WHEN enough THEN 0.4::DOUBLE/2 WHEN n_rows*0.4::DOUBLE >= 2 THEN 0.4::DOUBLE "
    "ELSE least(1.0::DOUBLE, (n_rows*0.4::DOUBLE + share)/n_rows) END AS rate, 'ok' AS status FROM g, t",
    digits=("rate",),
)
def rebalanced_group_rates(spark, folder):
    profile = keystats.group_profile(table(spark, folder, "orders"), "o_custkey", "o_orderstatus")
    return strata.rebalanced_rates(profile, 3, 2, 0.4)


@query(
    "n13_key_and_predicate_rate",
    q.ctes(
        ls=q.stats("lineitem", "l_partkey", "l_linenumber"),
        lv="SELECT l_quantity AS value, l_partkey AS key, CAST(count(*) AS DOUBLE) AS a FROM lineitem GROUP BY 1, 2",
        rc=q.counts("lineitem", "l_partkey"),
        m=q.moments(),
        v="SELECT sum((a*a - a)*(b*b - b)) AS v1, sum(a*b) AS v2 FROM lv JOIN rc USING (key)",
    )
    + "SELECT sqrt(0.01::DOUBLE*0.01::DOUBLE*(a2b2 - a2b - ab2 + ab)/ab) AS rate_key, "
    "sqrt(0.01::DOUBLE*0.01::DOUBLE*(a2b2 - a2b - ab2 + ab + v1)/(ab + v2)) AS rate_key_and_predicate FROM m, v",
    digits=("rate_key", "rate_key_and_predicate"),
)
def key_and_predicate_rate(spark, folder):
    rows = table(spark, folder, "lineitem")
    counts = keystats.key_counts(rows, "l_partkey")
    by_value = keystats.key_stats(rows, "l_partkey", None, ["l_quantity"])
    whole = moments(keystats.key_stats(rows, "l_partkey", None), counts)
    planned = central.key_and_predicate_rates(whole, moments(by_value, counts, ["l_quantity"]), 0.01, 0.01)
    return planned.select("rate_key", "rate_key_and_predicate")


# ---------------------------------------------------------------- two-level parameters

_X = (
    "(greatest(0.0::DOUBLE, (1.0/(q*q) - 1)*(a - 1)*(b - 1) + (1.0/q - 1)*(b - 1)*(a*a - a + 1) "
    "+ (1.0/q - 1)*(a - 1)*(b*b - b + 1)) + a*a*b*b)"
)
_Y = "(2 + q*(a + b - 2))"
TWO_LEVEL = {
    "fr": "SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM (" + q.counts("events", "user_id", "a") + ") JOIN ("
    + q.counts("orders", "o_custkey") + ") USING (key) GROUP BY a, b",
    "lo": "SELECT 0.25::DOUBLE/max(a + b) AS least FROM fr",
    "g1": "SELECT pow(least, i/32.0::DOUBLE) AS q FROM lo, range(33) t(i)",
    "t1": f"SELECT q, sum(n*sqrt({_X}*{_Y})) AS total FROM fr, g1 GROUP BY q",
    "q0": "SELECT q AS near FROM t1 ORDER BY total, q LIMIT 1",
    "g2": "SELECT DISTINCT least(1.0::DOUBLE, greatest(least, near * pow(least, (i - 32)/1024.0::DOUBLE))) AS q FROM q0, lo, range(65) t(i)",
    "t2": f"SELECT q, sum(n*sqrt({_X}*{_Y})) AS total FROM fr, g2 GROUP BY q",
    "par": "SELECT q, total, 0.1::DOUBLE*(SELECT count(*) FROM events)/total AS c FROM t2 ORDER BY total, q LIMIT 1",
}
KEY_RATES = {
    "raw": f"SELECT key, a, b, q, c*sqrt({_X}/{_Y}) AS p FROM (" + q.counts("events", "user_id", "a") + ") JOIN ("
    + q.counts("orders", "o_custkey") + ") USING (key), par",
    "kr": "SELECT key, a, b, least(p, 1.0::DOUBLE) AS p, CASE WHEN p > 1 AND a + b <= 2 THEN 1.0::DOUBLE WHEN p > 1 THEN "
    "least(1.0::DOUBLE, (p*(2 + q*(a + b - 2)) - 2)/(a + b - 2)) ELSE q END AS q FROM raw",
}


@query(
    "n14_two_level_parameters",
    q.ctes(**TWO_LEVEL) + "SELECT * FROM par",
    digits=("q", "total", "c"),
)
def two_level_parameters(spark, folder):
    left, right = table(spark, folder, "events"), table(spark, folder, "orders")
    return two_level.row_rate(two_level.frequency_pairs(left, right, "user_id", "o_custkey"), left, 0.1)


# ---------------------------------------------------------------- theoretical variances


def _variance_sql(settings: list[tuple], names: tuple[str, ...], p: str, e1: str, e2: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")" for row in settings)
    columns = ", ".join(f"{q.variance(agg, p, e1, e2)} AS {agg}_variance" for agg in VARIANCES)
    return f"SELECT {', '.join(names)}, {columns} FROM m, (VALUES {body}) v({', '.join(names)})"


_PRESET_ROWS = [(budget, p, rate) for budget, rows in PRESETS.items() for p, rate in rows]
_VARIANCE_COLUMNS = tuple(f"{agg}_variance" for agg in VARIANCES)


@query(
    "n15_preset_variances",
    q.ctes(**EVENT_ORDER)
    + _variance_sql(_PRESET_ROWS, ("budget", "p", "q"), "p", "(p*q)", "(p*q)"),
    digits=_VARIANCE_COLUMNS,
)
def preset_variances(spark, folder):
    return central.preset_variances(event_order_moments(spark, folder))


_CURVE = [0.01 + 0.033 * i for i in range(31)]


@query(
    "n16_variance_curve",
    q.ctes(**EVENT_ORDER) + _variance_sql([(p, 0.01, 0.01) for p in _CURVE], ("p", "e1", "e2"), "p", "e1", "e2"),
    digits=_VARIANCE_COLUMNS,
)
def variance_curve(spark, folder):
    return central.variance_curve(event_order_moments(spark, folder), 0.01, 0.01, _CURVE)


@query(
    "n17_count_variance_bound",
    q.ctes(**_STARS, r=_DEC_COUNT + "(SELECT (SELECT max(a) FROM la) AS a_star, (SELECT max(b) FROM rb) AS b_star))")
    + "SELECT p, a, n_b, (1.0/p - 1)*a*a*n_b*n_b + (1.0/0.01::DOUBLE - 1.0/p)*a*a*n_b + (1.0/0.01::DOUBLE - 1.0/p)*a*n_b*n_b "
    "+ (p/(0.01::DOUBLE*0.01::DOUBLE) - 1.0/0.01::DOUBLE - 1.0/0.01::DOUBLE + 1.0/p)*a*n_b AS variance_bound "
    "FROM (SELECT p, a_star AS a, (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS n_b FROM r)",
    digits=("p", "variance_bound"),
)
def count_variance_bound(spark, folder):
    left = decentral.side_maximum(keystats.key_counts(table(spark, folder, "events"), "user_id", "a"), "a")
    right = decentral.side_maximum(keystats.key_counts(table(spark, folder, "orders"), "o_custkey"), "b")
    rates = decentral.count_rates(left, right, 0.01, 0.01)
    return decentral.count_variance_bound(rates, table(spark, folder, "orders"), 0.01, 0.01)


@query(
    "s08_fixed_size_strata",
    "SELECT event_type AS grp, CAST(count(*) AS DOUBLE) AS n_rows, count(*)*0.05::DOUBLE < 100 AS is_low, 100.0::DOUBLE AS k, 0.05::DOUBLE AS q "
    "FROM events GROUP BY event_type",
)
def fixed_size_strata(spark, folder):
    from catalogue.common import event_side

    return stratified.fixed_size_strata(event_side(spark, folder), "event_type", 100, 0.05)
