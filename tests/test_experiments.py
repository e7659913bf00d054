"""Runs that die at any step and are run again; units that are committed twice; budgets that are spent."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thinjoin import Rates, approx_join_agg, exact_join_agg
from thinjoin.evaluation import experiment as experiments
from thinjoin.evaluation.experiment import Experiment, GroupBudget
from thinjoin.operators import filters, keystats
from thinjoin.operators.estimate import estimates, grouped_estimates
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import Side, sample_pair
from thinjoin.plans import central, strata
from thinjoin.session import new_path
from thinjoin.sources import catalog
from thinjoin.sources.committed import CommittedTable

RATES = Rates.preset(0.5, 0.5)
BUDGET = GroupBudget("count", 0.5, 0.4, 5, 3)


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(600)
    left = rows.select(
        (F.col("id") % 17).alias("k"),
        F.col("id").alias("row"),
        (F.col("id") % 23).cast("double").alias("x"),
        F.when(F.col("id") % 40 == 0, None).when(F.col("id") % 31 == 0, "rare").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("grp"),
    )
    right = rows.select((F.col("id") % 19).alias("k"), F.col("id").alias("row"))
    return Side(left, "k", ("row",)), Side(right, "k", ("row",))


def make(spark, sides, folder=None, seed=5):
    return Experiment(*sides, "one", "two", "x", folder or new_path(spark, "experiment"), seed)


def plan_of(sides):
    left, right = sides
    profile = keystats.group_profile(left.table, "grp", "k")
    found = moments(keystats.key_stats(left.table, "k", "x", ["grp"]), keystats.key_counts(right.table, "k"), ["grp"])
    pooled = central.pooled_rates(found, "count", BUDGET.e1, BUDGET.e2)
    return strata.group_parameters(strata.spent_budget_rates(profile, BUDGET.key_t, BUDGET.row_t, BUDGET.e1), pooled, BUDGET.e2)


RUNS = {
    "plain": lambda e, sides: e.run(RATES, 5),
    "presets": lambda e, sides: e.run([RATES, Rates.preset(1.0, 0.3)], 3),
    "where": lambda e, sides: e.run_where(RATES, 5, "x", ">=", [3, 10, 30]),
    "groups": lambda e, sides: e.run_groups("grp", BUDGET, plan_of(sides), 4),
}
KEYS = {"plain": ["query"], "presets": ["query"], "where": ["query", "cond_val"], "groups": ["answer", "grp"]}


def content(rows):
    kept = [c for c in rows.columns if c != "ts"]
    return sorted(map(str, rows.select(*kept).collect()))


class Died(Exception):
    pass


def dying(monkeypatch, at):
    """Every write of a batch and every commit, of samples too, is a step; the ``at``-th one fails, before or after it is done."""
    steps = {"n": 0}

    def wrap(owner, name):
        real = getattr(owner, name)

        def step(*args, **kwargs):
            for after in (False, True):
                if after:
                    done = real(*args, **kwargs)
                steps["n"] += 1
                if steps["n"] == at:
                    raise Died
            return done

        monkeypatch.setattr(owner, name, step)

    wrap(CommittedTable, "_write_rows")
    wrap(CommittedTable, "_commit")
    wrap(catalog, "write_sample")
    wrap(catalog, "record_sample")
    return steps


@pytest.mark.parametrize(("kind", "places"), [("plain", (0.5,)), ("presets", (0.9,)), ("where", (0.75,)), ("groups", (0.6,))])
def test_a_run_that_died_is_continued(spark, sides, monkeypatch, kind, places):
    monkeypatch.setattr(experiments, "REPLICATES_PER_JOB", 3)
    monkeypatch.setattr(catalog, "REPLICATES_PER_JOB", 3)
    run = RUNS[kind]
    with monkeypatch.context() as patch:
        steps = dying(patch, -1)
        want = content(run(make(spark, sides), sides))
    folder = new_path(spark, "experiment")
    for at in (1 + int(place * steps["n"]) for place in places):
        broken = make(spark, sides, f"{folder}/{at}")
        with monkeypatch.context() as patch:
            dying(patch, at)
            with pytest.raises(Died):
                run(broken, sides)
        again = run(broken, sides)
        assert content(again) == want, at
        assert again.groupBy(*KEYS[kind], "idx", *(["preset"] if "preset" in again.columns else [])).count().where("count > 1").isEmpty()


def test_more_replicates_values_and_groups_draw_nothing_again(spark, sides, monkeypatch):
    mine = make(spark, sides)
    mine.run_where(RATES, 4, "x", ">=", [3, 10])
    mine.run_groups("grp", BUDGET, plan_of(sides), 2, ["g0", None])
    drawn = []
    for owner, name in ((catalog, "sample_pair"), (experiments, "universe_strata_pair")):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, real=real, **k: drawn.append(a) or real(*a, **k))
    more = mine.run_where(RATES, 4, "x", ">=", [1, 3, 10])
    groups = mine.run_groups("grp", BUDGET, plan_of(sides), 2)
    assert not drawn
    assert content(more) == content(make(spark, sides).run_where(RATES, 4, "x", ">=", [1, 3, 10]))
    monkeypatch.undo()
    assert content(groups) == content(make(spark, sides).run_groups("grp", BUDGET, plan_of(sides), 2))
    assert groups.where("grp IS NULL").count() == 6
    assert mine.run(RATES, 4).count() == 12


def test_results_are_the_estimates(spark, sides):
    left, right = sides
    rows = {(r["query"], r["idx"]): r for r in make(spark, sides).run(RATES, 3).collect()}
    actual = exact_join_agg(left.table, right.table, "k", "k", "x").first()
    for r in estimates(sample_pair(left, right, RATES, 3, 5), "x").collect():
        for agg in ("count", "sum", "avg"):
            assert rows[agg, r["replicate"]]["estimate"] == pytest.approx(r[f"{agg}_estimate"])
            assert rows[agg, r["replicate"]]["actual"] == pytest.approx(actual[f"{agg}_actual"])


@pytest.mark.parametrize("op", [">=", "="])
def test_listed_predicates_are_filters(spark, sides, op):
    left, right = sides
    pair = sample_pair(left, right, RATES, 2, 6)
    values = [-5, 0, 7, 22, 50]
    found = {(r["cond_val"], r["replicate"]): r for r in filters.filtered_estimates(pair, "x", "x", op, values).collect()}
    exact = {r["cond_val"]: r for r in filters.filtered_answers(left.table, right.table, "k", "k", "x", "x", op, values).collect()}
    assert len(found) == 10 and len(exact) == 5
    for v in values:
        test = F.col("x") >= v if op == ">=" else F.col("x") == v
        assert tuple(exact[v])[1:] == pytest.approx(tuple(exact_join_agg(left.table, right.table, "k", "k", "x", left_where=test).first()))
        for r in estimates(pair, "x", left_where=test).collect():
            assert tuple(found[v, r["replicate"]])[3:] == pytest.approx(tuple(r)[2:])
    with pytest.raises(ValueError, match="unsupported"):
        filters.filtered_answers(left.table, right.table, "k", "k", "x", "x", "<", [1])


def test_a_unit_is_held_by_the_first_batch_that_names_it(spark):
    table = CommittedTable(new_path(spark, "units"), ("u",))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "u int, v string")
    assert table.read(spark) is None and table.commits(spark) is None
    table.add(rows, rows)
    table.add(rows.withColumn("v", F.upper("v")), rows)
    assert content(table.read(spark)) == content(rows)
    table._write_rows(rows, "b-dead")
    table._write_rows(rows.withColumn("v", F.lit("late")), "b-late")
    table._commit(rows.select("u").distinct(), "b-late")
    assert content(table.read(spark)) == content(rows)
    wanted = spark.createDataFrame([(1,), (2,), (None,), (3,)], "u int")
    assert sorted(r["u"] for r in table.missing(wanted).collect()) == [2, 3]
    table.add(spark.createDataFrame([(2, "d")], rows.schema), wanted)
    assert table.missing(wanted).isEmpty()
    assert table.read(spark).count() == 4
    assert sorted(table.drop_unread(spark)) == ["b-dead", "b-late"]
    assert table.read(spark).count() == 4


def test_group_by_in_the_public_entry(spark, sides):
    left, right = sides
    pair = sample_pair(left, right, RATES, 2, 7)
    found = {(r["replicate"], r["grp"]): r for r in grouped_estimates(pair, "x", ["grp"], left.table).collect()}
    assert len(found) == 2 * 5
    for grp in (None, "rare", "g0"):
        for r in estimates(pair, "x", left_where=F.col("grp").eqNullSafe(F.lit(grp))).collect():
            assert tuple(found[r["replicate"], grp])[3:] == pytest.approx(tuple(r)[2:])
    assert len(grouped_estimates(pair, "x", ["grp"]).collect()) <= 10
    by = approx_join_agg(left, right, "x", "sum", 1.0, 1.0, by=["grp"]).collect()
    exact = {r["grp"]: r["sum_actual"] for r in exact_join_agg(left.table, right.table, "k", "k", "x", "grp").collect()}
    assert {r["grp"]: r["estimate"] for r in by} == pytest.approx(exact)


@pytest.mark.parametrize(
    ("sizes", "row_t", "e1"),
    [([1000, 500, 20, 5, 3], 50, 0.2), ([1000, 3, 2, 1], 100, 0.5), ([10, 10], 50, 0.5), ([900, 60, 60, 60], 30, 0.4), ([100] * 4, 1, 0.3), ([5000, 1, 1], 9, 1.0)],
)
def test_the_whole_budget_is_spent(spark, sizes, row_t, e1):
    profile = spark.createDataFrame([(i, float(n), float(n)) for i, n in enumerate(sizes)], "grp int, n_rows double, n_keys double")
    rates = {r["grp"]: r["rate"] for r in strata.spent_budget_rates(profile, 10, row_t, e1).collect()}
    assert all(0 < r <= 1 for r in rates.values())
    assert sum(rates[i] * n for i, n in enumerate(sizes)) == pytest.approx(e1 * sum(sizes))
    needy = [i for i, n in enumerate(sizes) if n * e1 < row_t]
    extra = [rates[i] * sizes[i] - e1 * sizes[i] for i in needy if rates[i] < 1]
    assert all(x == pytest.approx(extra[0]) for x in extra)
