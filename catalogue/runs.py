"""Experiments that are continued, stored samples that are appended again, and strata by the real join key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.common import EVENT_ORDER, event_order_samples, event_side, order_side, pair_draws
from catalogue.registry import query, table
from catalogue.reporting import CONFIGURATION, REPLICATES, RESULTS, SEED, SETTINGS, stored_results
from catalogue.sampling import _STRATA, group_ctes, pooled_sql, strata_draws, universe_strata_sample
from thinjoin.evaluation.experiment import Experiment, GroupBudget
from thinjoin.evaluation.runs import AGGREGATES, result_table
from thinjoin.functions.hashing import Draws
from thinjoin.functions.rates import Rates
from thinjoin.operators import keystats, stratified
from thinjoin.operators.estimate import approx_join_agg
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import Side
from thinjoin.plans import central, strata
from thinjoin.session import new_path
from thinjoin.sources import catalog

_ANSWERS = ("actual", "estimate")
_ROWS = ("query", "preset", "idx", "left_dist", "right_dist", *_ANSWERS)


def experiment(spark, folder, seed: int) -> Experiment:
    left, right = event_side(spark, folder), order_side(spark, folder)
    return Experiment(left, right, "events", "orders", "cents", new_path(spark, "experiment"), seed)


# ---------------------------------------------------------------- plain runs


@query("v01_run", q.ctes(**RESULTS) + f"SELECT {', '.join(_ROWS)} FROM res", digits=_ANSWERS)
def run(spark, folder):
    return experiment(spark, folder, SEED).run(SETTINGS, REPLICATES).select(*_ROWS)


@query("v02_resumed_run", q.ctes(**RESULTS) + f"SELECT {', '.join(_ROWS)} FROM res", digits=_ANSWERS)
def resumed_run(spark, folder):
    """A run over fewer replicates, a batch that was never committed, one committed twice, and the run over all."""
    mine = experiment(spark, folder, SEED)
    some = mine.run(SETTINGS, REPLICATES // 2)
    results = mine.table("results", _RUN)
    results._write_rows(some, "b-broken")
    results._commit(some.select(*_RUN).distinct(), "b-broken")
    return mine.run(SETTINGS, REPLICATES).select(*_ROWS)


_RUN = ("left_dist", "right_dist", "t1_join_col", "t2_join_col", "t1_agg_col", "p", "q1", "q2", "seed", "preset", "idx")


@query("u02_retried_append", q.ctes(**RESULTS) + "SELECT query, preset, idx, actual, estimate FROM res", digits=_ANSWERS)
def retried_append(spark, folder):
    """Results in overlapping parts, each part appended twice."""
    held = result_table(new_path(spark, "results"), CONFIGURATION)
    rows = stored_results(spark, folder)
    for part in ("idx <= 7", "idx <= 7", "idx > 4", "idx > 4"):
        held.add(rows.where(part), rows.where(part))
    return held.read(spark).select("query", "preset", "idx", "actual", "estimate")


# ---------------------------------------------------------------- runs under a predicate

_PRESET, _WHERE_SEED, _CENTS = Rates.preset(0.4, 0.5), 311, (0, 2500, 5000, 12500, 20000, 999999)


def _where_sql(op: str) -> str:
    rates = f"SELECT {_PRESET.p!r}::DOUBLE AS p, {_PRESET.q1!r}::DOUBLE AS q1, {_PRESET.q2!r}::DOUBLE AS q2"
    parts = event_order_samples(rates, pair_draws(_PRESET, 6, _WHERE_SEED))
    parts["vals"] = f"SELECT CAST(unnest([{', '.join(map(str, _CENTS))}]) AS BIGINT) AS cond_val"
    parts["tv"] = (
        "SELECT l.replicate, cond_val, CAST(count(*) AS DOUBLE) AS n_join, sum(cents) AS s_join FROM s1 l JOIN s2 r "
        f"ON l.replicate = r.replicate AND l.user_id = r.o_custkey JOIN vals ON cents {op} cond_val GROUP BY ALL"
    )
    parts["act"] = (
        "SELECT cond_val, CAST(count(*) AS DOUBLE) AS count_actual, sum(cents) AS sum_actual, avg(cents) AS avg_actual "
        f"FROM {q.EVENTS} JOIN orders ON user_id = o_custkey JOIN vals ON cents {op} cond_val GROUP BY ALL"
    )
    scale = q.scale(_PRESET)
    guess = {"count": f"n_join*{scale}", "sum": f"s_join*{scale}", "avg": "s_join/n_join"}
    return q.ctes(**parts) + " UNION ALL ".join(
        f"SELECT '{agg}' AS query, d.replicate AS idx, vals.cond_val, coalesce({agg}_actual, 0.0) AS actual, coalesce({guess[agg]}, 0.0) AS estimate "
        "FROM draws d CROSS JOIN vals LEFT JOIN tv ON tv.replicate = d.replicate AND tv.cond_val = vals.cond_val LEFT JOIN act ON act.cond_val = vals.cond_val"
        for agg in AGGREGATES
    )


for _op, _name in ((">=", "at_least"), ("=", "equal")):

    @query(f"v01_where_results_{_name}", _where_sql(_op), digits=_ANSWERS)
    def where_results(spark, folder, op=_op):
        """Some values over some replicates, then more of both; the samples are drawn once."""
        mine = experiment(spark, folder, _WHERE_SEED)
        mine.run_where(_PRESET, 4, "cents", op, _CENTS[1:4])
        return mine.run_where(_PRESET, 6, "cents", op, _CENTS).select("query", "idx", "cond_val", *_ANSWERS)


# ---------------------------------------------------------------- strata: bands of the measure, which differ in their join keys

BANDS = "(SELECT event_id, user_id, event_type, round(value * 100) AS cents, CAST(floor(value / 50) AS INTEGER) AS band FROM events)"
_E1, _E2 = 0.3, 0.25
_PROPORTIONAL, _SPENT = ("proportional", 2), ("spent", 20)


def banded_side(spark, folder) -> Side:
    rows = table(spark, folder, "events")
    cents, band = F.round(F.col("value") * 100).alias("cents"), F.floor(F.col("value") / 50).cast("int").alias("band")
    return Side(rows.select("event_id", "user_id", "event_type", cents, band), "user_id", ("event_id",))


def band_plan(spark, folder, kind: str, row_t: int) -> tuple[DataFrame, float]:
    """Sampling parameters of the bands and the number of join keys from which a band is major."""
    left, right = banded_side(spark, folder), order_side(spark, folder)
    profile = keystats.group_profile(left.table, "band", left.key)
    key_t = profile.agg(F.avg("n_keys")).first()[0]
    found = moments(keystats.key_stats(left.table, left.key, "cents", ["band"]), keystats.key_counts(right.table, right.key), ["band"])
    plan = {"proportional": strata.proportional_rates, "spent": strata.spent_budget_rates}[kind]
    return strata.group_parameters(plan(profile, key_t, row_t, _E1), central.pooled_rates(found, "count", _E1, _E2), _E2), key_t


def band_sample(spark, folder, kind: str, row_t: int, replicates: int, seed: int):
    left, right = banded_side(spark, folder), order_side(spark, folder)
    return stratified.universe_strata_pair(left, right, "band", band_plan(spark, folder, kind, row_t)[0], replicates, seed)


def band_rates(kind: str, row_t: int) -> dict[str, str]:
    """Rates of the groups ``g``; the level up to which needy groups are filled is where the sorted rooms cross what is left."""
    e1 = f"{_E1}::DOUBLE"
    if kind == "proportional":
        return {
            "c": "SELECT is_major, CAST(count(*) AS DOUBLE) AS k, sum(n_rows) AS n FROM g GROUP BY is_major",
            "rated": f"SELECT g.*, CASE WHEN {row_t}*k <= {e1}*n THEN {row_t}::DOUBLE/n_rows + ({e1}*n - {row_t}*k)/n END AS rate, "
            f"CASE WHEN {row_t}*k <= {e1}*n THEN 'ok' ELSE 'budget exceeded' END AS status FROM g JOIN c USING (is_major)",
        }
    return {
        "kinds": f"SELECT *, n_rows*{e1}/2 >= {row_t} AS gives, n_rows*{e1} < {row_t} AS needs, n_rows - n_rows*{e1} AS room FROM g",
        "lft": f"SELECT coalesce(sum(n_rows*{e1}/2) FILTER (WHERE gives), 0.0) AS l, coalesce(sum(n_rows) FILTER (WHERE gives), 0.0) AS n FROM kinds",
        "rk": "SELECT room, row_number() OVER (ORDER BY room, grp) AS i, (l - coalesce(sum(room) OVER (ORDER BY room, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))"
        "/(count(*) OVER () - row_number() OVER (ORDER BY room, grp) + 1) AS level FROM kinds, lft WHERE needs",
        "lev": "SELECT coalesce(min(level) FILTER (WHERE i = f), 1e300) AS level FROM rk, (SELECT min(i) AS f FROM rk WHERE level < room)",
        "gv": "SELECT coalesce(sum(least(room, level)) FILTER (WHERE needs), 0.0) AS given FROM kinds, lev",
        "rated": f"SELECT grp, n_rows, n_keys, is_major, CASE WHEN gives THEN {e1}/2 + greatest(l - given, 0.0)/n WHEN needs THEN (n_rows*{e1} + least(room, level))/n_rows ELSE {e1} END AS rate, "
        "'ok' AS status FROM kinds, lft, lev, gv",
    }


def band_ctes(kind: str, row_t: int, draws: Draws) -> dict[str, str]:
    p1 = "CASE WHEN is_major = 1 THEN p ELSE 1.0::DOUBLE END"
    return {
        "ls": q.stats(BANDS, "user_id", "cents", ["band"]),
        "rc": q.counts("orders", "o_custkey"),
        "m": q.moments(by=["band"]),
        "r": pooled_sql("count", _E1, _E2),
        "prof": f"SELECT band AS grp, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT user_id) AS DOUBLE) AS n_keys FROM {BANDS} GROUP BY band",
        "g": "SELECT *, CAST(n_keys >= (SELECT avg(n_keys) FROM prof) AS INTEGER) AS is_major FROM prof",
        **band_rates(kind, row_t),
        "par": f"SELECT grp, is_major, status, {p1} AS p1, rate/({p1}) AS q1, p AS p2_major, {_E2}::DOUBLE*share/p AS q2_major, 1.0::DOUBLE AS p2_minor, "
        f"{_E2}::DOUBLE*(1 - share) AS q2_minor FROM (SELECT *, (SELECT avg(is_major) FROM g) AS share FROM rated), r",
        "draws": q.draws(draws),
        "s1": f"SELECT preset, replicate, event_id, user_id, band, cents FROM {BANDS} JOIN par ON band IS NOT DISTINCT FROM par.grp "
        f"CROSS JOIN draws WHERE {q.below(['user_id'], 'key', 'p1')} AND {q.below(['event_id'], 'left', 'q1')}",
        "s2": "SELECT * FROM (SELECT preset, replicate, o_orderkey, o_custkey, "
        f"{q.below(['o_custkey'], 'key', '(SELECT max(p2_major) FROM par)')} AND {q.below(['o_orderkey'], 'right', '(SELECT max(q2_major) FROM par)')} AS in_major, "
        f"{q.below(['o_orderkey'], 'right', '(SELECT max(q2_minor) FROM par)')} AS in_minor FROM orders, draws) WHERE in_major OR in_minor",
        "t": "SELECT l.replicate, band AS grp, CAST(count(*) AS DOUBLE) AS n_join, sum(cents) AS s_join FROM s1 l JOIN par ON band IS NOT DISTINCT FROM par.grp "
        "JOIN s2 r ON l.replicate = r.replicate AND l.user_id = r.o_custkey WHERE CASE WHEN is_major = 1 THEN in_major ELSE in_minor END GROUP BY 1, 2",
        "est": "SELECT d.replicate, par.grp, status, CASE WHEN sc IS NOT NULL THEN coalesce(n_join*sc, 0.0) END AS count_estimate, "
        "CASE WHEN sc IS NOT NULL THEN coalesce(s_join*sc, 0.0) END AS sum_estimate, CASE WHEN sc IS NOT NULL THEN coalesce(s_join/n_join, 0.0) END AS avg_estimate, "
        "n_join IS NOT NULL AS seen FROM draws d CROSS JOIN (SELECT *, 1.0::DOUBLE/(p1*least(q1, 1.0::DOUBLE)*CASE WHEN is_major = 1 THEN q2_major ELSE q2_minor END) AS sc FROM par) par "
        "LEFT JOIN t ON t.replicate = d.replicate AND t.grp IS NOT DISTINCT FROM par.grp",
    }


_PARAMETERS = ("p1", "q1", "p2_major", "q2_major", "p2_minor", "q2_minor")
_THREE = ("count_estimate", "sum_estimate", "avg_estimate")

for _kind, _row_t in (_PROPORTIONAL, _SPENT):

    @query(
        f"s10_band_parameters_{_kind}",
        q.ctes(**band_ctes(_kind, _row_t, strata_draws(1, 321))) + f"SELECT grp, is_major, status, {', '.join(_PARAMETERS)} FROM par",
        digits=_PARAMETERS,
    )
    def band_parameters(spark, folder, kind=_kind, row_t=_row_t):
        return band_plan(spark, folder, kind, row_t)[0]

    @query(
        f"s10_band_strata_left_{_kind}",
        q.ctes(**band_ctes(_kind, _row_t, strata_draws(2, 322))) + "SELECT replicate, event_id, user_id, band FROM s1",
    )
    def band_strata_left(spark, folder, kind=_kind, row_t=_row_t):
        return band_sample(spark, folder, kind, row_t, 2, 322).left.select("replicate", "event_id", "user_id", "band")

    @query(
        f"e08_band_strata_estimates_{_kind}",
        q.ctes(**band_ctes(_kind, _row_t, strata_draws(3, 323))) + f"SELECT replicate, grp, status, seen, {', '.join(_THREE)} FROM est",
        digits=_THREE,
    )
    def band_strata_estimates(spark, folder, kind=_kind, row_t=_row_t):
        found = stratified.universe_strata_estimates(band_sample(spark, folder, kind, row_t, 3, 323), "cents")
        return found.select("replicate", "grp", "status", "seen", *_THREE)


@query(
    "n12_spent_budget_rates",
    q.ctes(**band_ctes(*_SPENT, strata_draws(1, 324)))
    + f"SELECT grp, n_rows, n_keys, is_major, rate, status, abs(sum(rate*n_rows) OVER () - {_E1}::DOUBLE*sum(n_rows) OVER ()) < 1e-6 AS budget_met FROM rated",
    digits=("rate",),
)
def spent_budget_rates(spark, folder):
    profile = keystats.group_profile(banded_side(spark, folder).table, "band", "user_id")
    key_t = profile.agg(F.avg("n_keys")).first()[0]
    rates = strata.spent_budget_rates(profile, key_t, _SPENT[1], _E1)
    off = rates.agg(F.abs(F.sum(F.col("rate") * F.col("n_rows")) - F.lit(_E1) * F.sum("n_rows")) < 1e-6).scalar()
    return rates.withColumn("budget_met", off)


def _strat_sql(kind: str, row_t: int) -> str:
    parts = band_ctes(kind, row_t, strata_draws(5, 325))
    parts["act"] = (
        "SELECT band, CAST(count(*) AS DOUBLE) AS count_actual, sum(cents) AS sum_actual, avg(cents) AS avg_actual "
        f"FROM {BANDS} JOIN orders ON user_id = o_custkey GROUP BY band"
    )
    return q.ctes(**parts) + " UNION ALL ".join(
        f"SELECT '{agg}' AS answer, replicate AS idx, grp, seen, status, coalesce({agg}_actual, 0.0) AS actual, {agg}_estimate AS estimate "
        "FROM est LEFT JOIN act ON band IS NOT DISTINCT FROM grp"
        for agg in AGGREGATES
    )


@query("v01_strat_results", _strat_sql(*_SPENT), digits=_ANSWERS)
def strat_results(spark, folder):
    """Three bands over two replicates, all bands over two, then over five."""
    left, right = banded_side(spark, folder), order_side(spark, folder)
    mine = Experiment(left, right, "events", "orders", "cents", new_path(spark, "experiment"), 325)
    plan, key_t = band_plan(spark, folder, *_SPENT)
    budget = GroupBudget("count", _E1, _E2, key_t, _SPENT[1])
    mine.run_groups("band", budget, plan, 2, [0, 3, None])
    mine.run_groups("band", budget, plan, 2)
    found = mine.run_groups("band", budget, plan, 5)
    return found.select("answer", "idx", "grp", "seen", "status", *_ANSWERS)


@query("i06_group_sample_appended_twice", q.ctes(**group_ctes(*_STRATA, strata_draws(2, 326))) + "SELECT replicate, event_type, event_id, pval FROM s1")
def group_sample_appended_twice(spark, folder):
    path = new_path(spark, "group-sample")
    sample = universe_strata_sample(spark, folder, *_STRATA, 2, 326)
    for _ in range(2):
        catalog.append_group_sample(sample, path)
    return catalog.group_sample_table(path, "event_type").read(spark).select("replicate", "event_type", "event_id", "pval")


# ---------------------------------------------------------------- GROUP BY in the public entry


def _by_band_sql() -> str:
    rates = q.rates("m", "sum", 0.2, 0.2)
    parts = {**EVENT_ORDER, **event_order_samples(f"SELECT p, q1, q2 FROM ({rates})", pair_draws(Rates(1.0, 1.0, 1.0), 3, 331))}
    parts["s1"] = parts["s1"].replace(q.EVENTS, BANDS).replace("cents FROM", "cents, band FROM")
    parts["tb"] = q.totals("s1", "s2", "user_id", "o_custkey", "cents", ["band"])
    parts["bands"] = f"SELECT DISTINCT band FROM {BANDS}"
    return q.ctes(**parts) + (
        "SELECT d.replicate, b.band, coalesce(s_join/(p*q1*q2), 0.0) AS estimate FROM draws d CROSS JOIN bands b CROSS JOIN r "
        "LEFT JOIN tb ON tb.replicate = d.replicate AND tb.band IS NOT DISTINCT FROM b.band"
    )


@query("e08_sum_by_band", _by_band_sql(), digits=("estimate",))
def sum_by_band(spark, folder):
    left, right = banded_side(spark, folder), order_side(spark, folder)
    return approx_join_agg(left, right, "cents", "sum", 0.2, 0.2, 3, 331, by=["band"]).select("replicate", "band", "estimate")


