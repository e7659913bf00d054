"""Samplers and stored samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.common import (
    EVENT_ORDER,
    LINE_ID,
    LINE_ORDER,
    event_order_moments,
    event_order_samples,
    event_side,
    line_order_moments,
    line_side,
    literal_rates,
    order_side,
    pair_draws,
)
from catalogue.planning import (
    GROUPS,
    KEY_RATES,
    TWO_LEVEL,
    _dec_sum_sql,
    _joint_sql,
    _swept,
    _worst_case_rate_sql,
    decentral_avg,
    group_moments,
    pooled_sql,
)
from catalogue.registry import query, table
from thinjoin.functions.hashing import Draws, coefficients_needed
from thinjoin.functions.rates import PRESETS, Rates
from thinjoin.operators import keystats, sampling, stratified, sweep
from thinjoin.operators import two_level as two_level_module
from thinjoin.operators.sampling import Side, sample_pair
from thinjoin.plans import central, decentral, strata
from thinjoin.session import new_path, settle
from thinjoin.sources import catalog

LEFT = ("preset", "replicate", "event_id", "user_id", "cents")
RIGHT = ("preset", "replicate", "o_orderkey", "o_custkey")


def both_sides(pair) -> object:
    """Identities of the sampled rows of both sides, with the side they belong to."""
    left = pair.left.select(F.lit("left").alias("side"), "replicate", F.col("user_id").alias("key"), F.col("event_id").alias("row"))
    right = pair.right.select(F.lit("right").alias("side"), "replicate", F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row"))
    return left.unionByName(right)


BOTH_SIDES = (
    "SELECT 'left' AS side, replicate, user_id AS key, event_id AS row FROM s1 "
    "UNION ALL SELECT 'right', replicate, o_custkey, o_orderkey FROM s2"
)


def pair_sql(rates: str, draws: Draws) -> dict[str, str]:
    return event_order_samples(rates, draws)


@query(
    "s01_universe_sample",
    q.ctes(draws=q.draws(pair_draws(Rates(0.1, 1, 1), 3, 11)))
    + f"SELECT replicate, event_id, user_id FROM events, draws WHERE {q.below(['user_id'], 'key', '0.1::DOUBLE')}",
)
def universe_sample(spark, folder):
    side = Side(table(spark, folder, "events"), "user_id", ("event_id",))
    return sampling.universe_sample(side, 0.1, 3, seed=11).select("replicate", "event_id", "user_id")


_LINE_DRAWS = Draws(12, (1, 2), {"left": coefficients_needed(len(LINE_ID))})


@query(
    "s02_bernoulli_sample",
    q.ctes(draws=q.draws(_LINE_DRAWS))
    + f"SELECT replicate, {', '.join(LINE_ID)} FROM lineitem, draws WHERE {q.below(LINE_ID, 'left', '0.05::DOUBLE')}",
)
def bernoulli_sample(spark, folder):
    sampled = sampling.bernoulli_sample(line_side(spark, folder), 0.05, 2, seed=12)
    return sampled.select("replicate", *LINE_ID)


_PRESET = Rates.preset(0.333, 0.03)


@query("s03_preset_pair", q.ctes(**pair_sql(literal_rates(_PRESET), pair_draws(_PRESET, 5, 21))) + BOTH_SIDES)
def preset_pair(spark, folder):
    return both_sides(sample_pair(event_side(spark, folder), order_side(spark, folder), _PRESET, 5, 21))


_SWEEP = [Rates.preset(p, rate) for p, rate in PRESETS["10%"]]


@query(
    "s03_preset_sweep",
    q.ctes(**pair_sql("", pair_draws(_SWEEP, 2, 22)))
    + "SELECT preset, replicate, event_id, user_id, cents FROM s1",
)
def preset_sweep(spark, folder):
    return sample_pair(event_side(spark, folder), order_side(spark, folder), _SWEEP, 2, 22).left.select(*LEFT)


for _agg in ("count", "sum", "avg"):

    @query(
        f"s04_optimal_pair_{_agg}",
        q.ctes(**EVENT_ORDER, **pair_sql(q.rates("m", _agg, 0.05, 0.02), pair_draws(_PRESET, 3, 31))) + BOTH_SIDES,
    )
    def optimal_pair(spark, folder, agg=_agg):
        rates = central.sampling_rates(event_order_moments(spark, folder), agg, 0.05, 0.02)
        return both_sides(sample_pair(event_side(spark, folder), order_side(spark, folder), rates, 3, 31))


@query(
    "s04_optimal_pair_one_to_many",
    q.ctes(
        **LINE_ORDER,
        draws=q.draws(pair_draws(_PRESET, 2, 32, left_id=4)),
        r=q.rates("m", "count", 0.05, 0.05),
    )
    + f"SELECT replicate, {', '.join(LINE_ID)} FROM lineitem, draws WHERE {q.below(['l_orderkey'], 'key', '(SELECT p FROM r)')} "
    f"AND {q.below(LINE_ID, 'left', '(SELECT q1 FROM r)')}",
)
def optimal_pair_one_to_many(spark, folder):
    rates = central.sampling_rates(line_order_moments(spark, folder), "count", 0.05, 0.05)
    pair = sample_pair(line_side(spark, folder), order_side(spark, folder, "o_orderkey"), rates, 2, 32)
    return pair.left.select("replicate", *LINE_ID)


_STARS = (
    "SELECT p, 0.05::DOUBLE/p AS q1, 0.05::DOUBLE/p AS q2 FROM (SELECT least(1.0::DOUBLE, greatest(0.05::DOUBLE, "
    "sqrt(0.05::DOUBLE*0.05::DOUBLE*(a_star*b_star - a_star - b_star + 1)))) AS p FROM "
    "(SELECT (SELECT max(a) FROM ls) AS a_star, (SELECT max(b) FROM rc) AS b_star))"
)


@query(
    "s05_decentral_pair",
    q.ctes(
        ls=EVENT_ORDER["ls"], rc=EVENT_ORDER["rc"], **pair_sql(_STARS, pair_draws(_PRESET, 3, 41))
    )
    + BOTH_SIDES,
)
def decentral_pair(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    rates = decentral.count_rates(
        decentral.side_maximum(keystats.key_counts(left.table, left.key, "a"), "a"),
        decentral.side_maximum(keystats.key_counts(right.table, right.key), "b"),
        0.05,
        0.05,
    )
    return both_sides(sample_pair(left, right, rates, 3, 41))


@query(
    "s05_decentral_pair_sum",
    q.ctes(
        **pair_sql(
            "SELECT p, q1, q2 FROM (" + _dec_sum_sql(q.stats(q.EVENTS, "user_id", "cents"), "orders", 0.05, 0.05) + ")",
            pair_draws(_PRESET, 3, 42),
        )
    )
    + BOTH_SIDES,
)
def decentral_pair_sum(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    stats = keystats.key_stats(left.table, left.key, "cents")
    return both_sides(sample_pair(left, right, decentral.sum_rates(stats, right.table, 0.05, 0.05), 3, 42))


@query(
    "s05_decentral_pair_avg",
    q.ctes(**pair_sql("SELECT p, q1, q2 FROM (" + _worst_case_rate_sql() + ")", pair_draws(_PRESET, 3, 43))) + BOTH_SIDES,
)
def decentral_pair_avg(spark, folder):
    return both_sides(sample_pair(event_side(spark, folder), order_side(spark, folder), decentral_avg(spark, folder), 3, 43))


@query(
    "s06_joint_pair",
    q.ctes(**EVENT_ORDER, **pair_sql(_joint_sql(0.02, 0.02), pair_draws(_PRESET, 3, 51))) + BOTH_SIDES,
)
def joint_pair(spark, folder):
    rates = central.joint_rates(event_order_moments(spark, folder), 0.02, 0.02)
    return both_sides(sample_pair(event_side(spark, folder), order_side(spark, folder), rates, 3, 51))


_COUNT_TERMS = q.objective("count", 0.01, 0.01)
_PART_DRAWS = pair_draws(_PRESET, 2, 61, left_id=4, right_id=4)


@query(
    "s07_predicate_pair",
    q.ctes(
        **_swept(10, ">="),
        r=q.rates_from(f"SELECT sum({_COUNT_TERMS[0]}) AS val1, sum({_COUNT_TERMS[1]}) AS val2 FROM m", 0.01, 0.01),
        draws=q.draws(_PART_DRAWS),
    )
    + f"SELECT replicate, {', '.join(LINE_ID)} FROM lineitem, draws WHERE {q.below(['l_partkey'], 'key', '(SELECT p FROM r)')} "
    f"AND {q.below(LINE_ID, 'left', '(SELECT q1 FROM r)')}",
)
def predicate_pair(spark, folder):
    side = line_side(spark, folder, "l_partkey")
    swept = sweep.sweep_moments(side.table, side.table, side.key, side.key, "l_linenumber", "l_quantity", 10, ">=")
    pair = sample_pair(side, side, central.pooled_rates(swept, "count", 0.01, 0.01), 2, 61)
    return pair.left.select("replicate", *LINE_ID)


def _predicate_pair(agg: str, op: str, step: int, seed: int) -> None:
    terms = q.objective(agg, 0.01, 0.01)
    draws = pair_draws(_PRESET, 2, seed, left_id=4, right_id=4)
    rates = q.rates_from(f"SELECT sum({terms[0]}) AS val1, sum({terms[1]}) AS val2 FROM m", 0.01, 0.01)
    kept = f"{q.below(['l_partkey'], 'key', '(SELECT p FROM r)')} AND {q.below(LINE_ID, 'left', '(SELECT q1 FROM r)')}"
    sql = q.ctes(**_swept(step, op), r=rates, draws=q.draws(draws)) + f"SELECT replicate, {', '.join(LINE_ID)} FROM lineitem, draws WHERE {kept}"

    @query(f"s07_predicate_pair_{agg}_{'equal' if op == '=' else 'at_least'}", sql)
    def planned(spark, folder):
        side = line_side(spark, folder, "l_partkey")
        swept = sweep.sweep_moments(side.table, side.table, side.key, side.key, "l_linenumber", "l_quantity", step, op)
        pair = sample_pair(side, side, central.pooled_rates(swept, agg, 0.01, 0.01), 2, seed)
        return pair.left.select("replicate", *LINE_ID)


_predicate_pair("count", "=", 5, 62)
_predicate_pair("sum", ">=", 10, 63)
_predicate_pair("avg", "=", 5, 64)


# ---------------------------------------------------------------- strata


def strata_draws(replicates: int, seed: int, extra: tuple[str, ...] = ()) -> Draws:
    roles = {name: coefficients_needed(1) for name in ("key", "left", "right", *extra)}
    return Draws(seed, tuple(range(1, replicates + 1)), roles)


def fixed_size_ctes(limit: int, rate: float, draws: Draws) -> dict[str, str]:
    return {
        "draws": q.draws(draws),
        "st": f"SELECT event_type AS grp, CAST(count(*) AS DOUBLE) AS n_rows, count(*)*{rate}::DOUBLE < {limit} AS is_low FROM events GROUP BY event_type",
        "e": f"SELECT * FROM {q.EVENTS} JOIN st ON event_type = grp CROSS JOIN draws",
        "s1": f"SELECT preset, replicate, event_id, user_id, event_type, cents FROM e WHERE NOT is_low AND {q.below(['event_id'], 'left', f'{rate}::DOUBLE')} "
        f"UNION ALL SELECT preset, replicate, event_id, user_id, event_type, cents FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY replicate, event_type ORDER BY {q.hashed(['event_id'], 'rank')}, event_id) AS rn FROM e WHERE is_low) WHERE rn <= {limit}",
        "s2": f"SELECT preset, replicate, o_orderkey, o_custkey FROM orders, draws WHERE {q.below(['o_orderkey'], 'right', f'{rate}::DOUBLE')}",
    }


@query(
    "s08_fixed_size_strata_pair",
    q.ctes(**fixed_size_ctes(100, 0.0499, strata_draws(2, 71, ("rank",)))) + BOTH_SIDES,
)
def fixed_size_pair(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    return both_sides(stratified.fixed_size_strata_pair(left, right, "event_type", 100, 0.0499, 2, 71))


@query(
    "w01_rows_per_group",
    q.ctes(**fixed_size_ctes(50, 0.0001, strata_draws(1, 72, ("rank",)))) + "SELECT replicate, event_type, event_id FROM s1",
)
def rows_per_group(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    sample = stratified.fixed_size_strata_pair(left, right, "event_type", 50, 0.0001, 1, 72)
    return sample.left.select("replicate", "event_type", "event_id")


def group_ctes(agg: str, e1: float, e2: float, row_t: int, draws: Draws) -> dict[str, str]:
    """Universe strata over event types: the types with at least the average number of keys are major."""
    return {
        **GROUPS,
        "r": pooled_sql(agg, e1, e2),
        "prof": "SELECT event_type AS grp, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT event_id // 7) AS DOUBLE) AS n_keys FROM events GROUP BY event_type",
        "g": "SELECT *, CAST(n_keys >= (SELECT avg(n_keys) FROM prof) AS INTEGER) AS is_major FROM prof",
        "c": "SELECT is_major, CAST(count(*) AS DOUBLE) AS k, sum(n_rows) AS n FROM g GROUP BY is_major",
        "par": f"SELECT grp, is_major, CASE WHEN is_major = 1 THEN p ELSE 1.0::DOUBLE END AS p1, rate/(CASE WHEN is_major = 1 THEN p ELSE 1.0::DOUBLE END) AS q1, "
        f"p AS p2_major, {e2}::DOUBLE*share/p AS q2_major, 1.0::DOUBLE AS p2_minor, {e2}::DOUBLE*(1 - share) AS q2_minor FROM "
        f"(SELECT grp, is_major, {row_t}::DOUBLE/n_rows + ({e1}::DOUBLE*n - {row_t}*k)/n AS rate, (SELECT avg(is_major) FROM g) AS share "
        "FROM g JOIN c USING (is_major)), r",
        "draws": q.draws(draws),
        "s1": f"SELECT preset, replicate, event_id, user_id, event_type, cents, {q.hashed(['user_id'], 'key')} AS pval FROM {q.EVENTS} JOIN par ON event_type = grp "
        f"CROSS JOIN draws WHERE {q.below(['user_id'], 'key', 'p1')} AND {q.below(['event_id'], 'left', 'q1')}",
        "s2": "SELECT * FROM (SELECT preset, replicate, o_orderkey, o_custkey, "
        f"{q.below(['o_custkey'], 'key', '(SELECT max(p2_major) FROM par)')} AND {q.below(['o_orderkey'], 'right', '(SELECT max(q2_major) FROM par)')} AS in_major, "
        f"{q.below(['o_orderkey'], 'right', '(SELECT max(q2_minor) FROM par)')} AS in_minor FROM orders, draws) WHERE in_major OR in_minor",
    }


def universe_strata_sample(spark, folder, agg: str, e1: float, e2: float, row_t: int, replicates: int, seed: int):
    """Event types split by a stand-in for their number of keys, which differs between the types at every scale."""
    left, right = event_side(spark, folder), order_side(spark, folder)
    rows = left.table.withColumn("_block", F.expr("event_id div 7"))
    profile = keystats.group_profile(rows, "event_type", "_block")
    key_t = profile.agg(F.avg("n_keys").alias("t")).first()["t"]
    pooled = central.pooled_rates(group_moments(spark, folder), agg, e1, e2)
    parameters = strata.group_parameters(strata.proportional_rates(profile, key_t, row_t, e1), pooled, e2)
    return stratified.universe_strata_pair(left, right, "event_type", parameters, replicates, seed)


_STRATA = ("count", 0.1, 0.08, 10)


@query(
    "s10_group_parameters",
    q.ctes(**group_ctes(*_STRATA, strata_draws(1, 81)))
    + "SELECT grp, is_major, 'ok' AS status, p1, q1, p2_major, q2_major, p2_minor, q2_minor FROM par",
    digits=("p1", "q1", "p2_major", "q2_major", "p2_minor", "q2_minor"),
)
def group_parameters(spark, folder):
    return universe_strata_sample(spark, folder, *_STRATA, 1, 81).parameters


@query(
    "s10_universe_strata_left",
    q.ctes(**group_ctes(*_STRATA, strata_draws(2, 81))) + "SELECT replicate, event_id, user_id, event_type FROM s1",
)
def universe_strata_left(spark, folder):
    sample = universe_strata_sample(spark, folder, *_STRATA, 2, 81)
    return sample.left.select("replicate", "event_id", "user_id", "event_type")


@query(
    "s10_universe_strata_right",
    q.ctes(**group_ctes(*_STRATA, strata_draws(2, 81))) + "SELECT replicate, o_orderkey, o_custkey, in_major, in_minor FROM s2",
)
def universe_strata_right(spark, folder):
    sample = universe_strata_sample(spark, folder, *_STRATA, 2, 81)
    return sample.right.select("replicate", "o_orderkey", "o_custkey", "in_major", "in_minor")


@query(
    "i06_group_sample_append",
    q.ctes(**group_ctes(*_STRATA, strata_draws(2, 82))) + "SELECT replicate, event_type, event_id, pval FROM s1",
)
def group_sample_append(spark, folder):
    path = new_path(spark, "group-sample")
    catalog.append_group_sample(universe_strata_sample(spark, folder, *_STRATA, 2, 82), path)
    return catalog.group_sample_table(path, "event_type").read(spark).select("replicate", "event_type", "event_id", "pval")


# ---------------------------------------------------------------- two-level


def two_level_draws(replicates: int, seed: int) -> Draws:
    roles = {"key": coefficients_needed(1)}
    for name in ("left", "left_first", "left_second", "right", "right_first", "right_second"):
        roles[name] = coefficients_needed(1)
    return Draws(seed, tuple(range(1, replicates + 1)), roles)


def two_level_ctes(draws: Draws) -> dict[str, str]:
    def side(source: str, key: str, row: str, role: str) -> str:
        return (
            f"SELECT preset, replicate, {key}, {row}, p AS key_rate, q AS row_rate, rn = 1 AS is_sentry FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY replicate, {key} ORDER BY {q.hashed([row], role + '_first')}, {q.hashed([row], role + '_second')}) AS rn FROM {source} "
            f"JOIN kk ON {key} = kk.key JOIN draws USING (preset, replicate)) "
            f"WHERE rn = 1 OR {q.below([row], role, 'q')}"
        )

    return {
        **TWO_LEVEL,
        **KEY_RATES,
        "draws": q.draws(draws),
        "kk": f"SELECT preset, replicate, key, p, q FROM kr, draws WHERE {q.below(['key'], 'key', 'p')}",
        "s1": side("events", "user_id", "event_id", "left"),
        "s2": side("orders", "o_custkey", "o_orderkey", "right"),
    }


def two_level(spark, folder, replicates: int, seed: int):
    left, right = event_side(spark, folder), order_side(spark, folder)
    rates = settle(two_level_module.key_rates(left, right, 0.1), "key-rates")
    return two_level_module.two_level_sample(left, right, rates, replicates, seed)


@query(
    "n14_two_level_key_rates",
    q.ctes(**TWO_LEVEL, **KEY_RATES) + "SELECT * FROM kr",
    digits=("p", "q"),
)
def two_level_key_rates(spark, folder):
    return two_level_module.key_rates(event_side(spark, folder), order_side(spark, folder), 0.1)


@query(
    "s09_two_level_left",
    q.ctes(**two_level_ctes(two_level_draws(3, 91))) + "SELECT replicate, user_id, event_id, is_sentry FROM s1",
)
def two_level_left(spark, folder):
    return two_level(spark, folder, 3, 91).left.select("replicate", "user_id", "event_id", "is_sentry")


@query(
    "s09_two_level_right",
    q.ctes(**two_level_ctes(two_level_draws(3, 91))) + "SELECT replicate, o_custkey, o_orderkey, is_sentry FROM s2",
)
def two_level_right(spark, folder):
    return two_level(spark, folder, 3, 91).right.select("replicate", "o_custkey", "o_orderkey", "is_sentry")


@query(
    "w02_one_row_per_key",
    q.ctes(**two_level_ctes(two_level_draws(1, 92))) + "SELECT user_id, event_id FROM s1 WHERE is_sentry",
)
def one_row_per_key(spark, folder):
    return two_level(spark, folder, 1, 92).left.where("is_sentry").select("user_id", "event_id")


# ---------------------------------------------------------------- stored samples

IDENTITY = {
    "t1_name": "events",
    "t2_name": "orders",
    "agg": "count",
    "t1_join_col": "user_id",
    "t2_join_col": "o_custkey",
    "t1_agg_col": "cents",
}


@query(
    "i05_stored_pair",
    q.ctes(**EVENT_ORDER, **pair_sql(q.rates("m", "count", 0.05, 0.05), pair_draws(_PRESET, 4, 101)))
    + "SELECT 'left' AS side, replicate, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM s1 GROUP BY replicate "
    "UNION ALL SELECT 'right', replicate, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM s2 GROUP BY replicate",
)
def stored_pair(spark, folder):
    """Two replicates first, then four: the second call draws only the two that are missing."""
    left, right = event_side(spark, folder), order_side(spark, folder)
    rates = sampling.fixed_rates(central.sampling_rates(event_order_moments(spark, folder), "count", 0.05, 0.05))
    path = new_path(spark, "samples")
    for replicates in (2, 4):
        catalog.store_pair(left, right, rates, path, replicates, IDENTITY, seed=101)
    pair = catalog.load_pair(left, right, path, 4, IDENTITY)
    one = pair.left.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    two = pair.right.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))
    return one.withColumn("side", F.lit("left")).unionByName(two.withColumn("side", F.lit("right")))


@query(
    "i05_stored_at_two_rates",
    q.ctes(
        **pair_sql(literal_rates(Rates(0.9, 0.8, 0.7)), pair_draws(_PRESET, 2, 102)),
    )
    + "SELECT CAST(0.9 AS DOUBLE) AS p, CAST(0.8 AS DOUBLE) AS q1, CAST(0.7 AS DOUBLE) AS q2, replicate, count(*) AS n, "
    "CAST(sum(event_id) AS BIGINT) AS total FROM s1 GROUP BY replicate",
)
def stored_at_two_rates(spark, folder):
    """Another rate in the same folder is drawn, not taken for stored, and opened with its own rates."""
    left, right = event_side(spark, folder), order_side(spark, folder)
    path = new_path(spark, "samples")
    for rates in (Rates(0.5, 0.5, 0.5), Rates(0.9, 0.8, 0.7)):
        catalog.store_pair(left, right, rates, path, 2, IDENTITY, seed=102)
    pair = catalog.load_pair(left, right, path, 2, IDENTITY)
    rates = [F.lit(getattr(pair.rates, n)).alias(n) for n in ("p", "q1", "q2")]
    found = pair.left.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    return found.select(*rates, "replicate", "n", "total")


@query(
    "i05_overwritten_by_empty_draw",
    "SELECT 0::BIGINT AS n, (SELECT count(*) FROM events) AS n_first",
)
def overwritten_by_empty_draw(spark, folder):
    """An overwriting draw without a row leaves none of the rows before it."""
    left, right = event_side(spark, folder), order_side(spark, folder)
    path, full, nothing = new_path(spark, "samples"), Rates(1.0, 1.0, 1.0), Rates(1e-9, 1.0, 1.0)
    catalog.store_pair(left, right, full, path, 1, IDENTITY)
    first = catalog.load_pair(left, right, path, 1, IDENTITY).left.agg(F.count(F.lit(1)).alias("n_first"))
    catalog.store_pair(left, right, nothing, path, 1, IDENTITY, overwrite=True)
    second = catalog.load_pair(left, right, path, 1, IDENTITY).left.agg(F.count(F.lit(1)).alias("n"))
    return second.select("n", first.scalar().alias("n_first"))


_META = ", ".join(f"'{v}' AS {k}" for k, v in IDENTITY.items())


@query(
    "i07_sample_metadata",
    q.ctes(**EVENT_ORDER)
    + " UNION ALL ".join(
        f"SELECT {_META}, 0::INTEGER AS preset, 1::INTEGER AS replicate, p, q1, q2 FROM ({q.rates('m', 'count', e, e)})" for e in (0.01, 0.05)
    ),
    digits=("p", "q1", "q2"),
)
def sample_metadata(spark, folder):
    return _two_plans(spark, folder).drop("ts", "seed", "path")


@query(
    "i08_latest_metadata",
    q.ctes(**EVENT_ORDER)
    + f"SELECT {_META}, 0::INTEGER AS preset, 1::INTEGER AS replicate, p, q1, q2 FROM ({q.rates('m', 'count', 0.05, 0.05)})",
    digits=("p", "q1", "q2"),
)
def latest_metadata(spark, folder):
    return catalog.latest_samples(_two_plans(spark, folder)).drop("ts", "seed", "path")


def _two_plans(spark, folder):
    left, right = event_side(spark, folder), order_side(spark, folder)
    found, path = event_order_moments(spark, folder), new_path(spark, "meta")
    for budget in (0.01, 0.05):
        pair = sample_pair(left, right, central.sampling_rates(found, "count", budget, budget))
        catalog.record_sample(pair, path, IDENTITY)
    return spark.read.parquet(path)


@query(
    "j02_sample_join",
    q.ctes(**pair_sql(literal_rates(_PRESET), pair_draws(_PRESET, 3, 111)))
    + "SELECT s1.replicate, event_id, user_id, o_orderkey FROM s1 JOIN s2 ON s1.replicate = s2.replicate AND user_id = o_custkey",
)
def sample_join(spark, folder):
    pair = sample_pair(event_side(spark, folder), order_side(spark, folder), _PRESET, 3, 111)
    return sampling.joined_samples(pair).select("replicate", "event_id", "user_id", "o_orderkey")

