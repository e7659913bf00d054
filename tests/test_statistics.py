"""Statistical checks: unbiased estimates, and measured variance close to the theoretical one."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from thinjoin import Rates, estimates, exact_join_agg, key_counts, key_stats, moments, sample_pair
from thinjoin.evaluation import metrics, runs
from thinjoin.functions import hashing
from thinjoin.functions.hashing import PRIME
from thinjoin.operators import sampling, sketches, stratified, sweep, two_level
from thinjoin.operators.sampling import Side
from thinjoin.plans import central, strata
from thinjoin.session import settle

REPLICATES = 300


@pytest.fixture(scope="module")
def sides(spark):
    """60 keys; key 0 holds a third of the left rows; measures depend on the key."""
    left = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 60).alias("k"),
        F.col("id").alias("row"),
        ((F.col("id") * 7919) % 97 + F.col("id") % 60).cast("double").alias("x"),
        (F.col("id") % 4).alias("grp"),
    )
    right = spark.range(900).select(((F.col("id") * F.col("id")) % 60).alias("k"), F.col("id").alias("row"))
    return Side(settle(left, "left"), "k", ("row",)), Side(settle(right, "right"), "k", ("row",))


@pytest.fixture(scope="module")
def found(sides):
    left, right = sides
    return settle(moments(key_stats(left.table, "k", "x"), key_counts(right.table, "k")), "moments")


def close_to_actual(rows, agg: str, actual: float, variance: float) -> None:
    values = [r[f"{agg}_estimate"] for r in rows]
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
    assert abs(mean - actual) <= 4.5 * math.sqrt(variance / len(values))
    assert 0.65 <= spread / variance <= 1.5


@pytest.mark.parametrize("p", [0.25, 0.5, 1.0])
def test_estimates_are_unbiased_with_the_stated_variance(sides, found, p):
    left, right = sides
    rates = Rates.from_budget(p, 0.2, 0.1)
    rows = estimates(sample_pair(left, right, rates, REPLICATES, 5), "x").collect()
    actual = exact_join_agg(left.table, right.table, "k", "k", "x").first()
    theory = central.variance_curve(found, 0.2, 0.1, [p]).first()
    for agg in ("count", "sum"):
        close_to_actual(rows, agg, float(actual[f"{agg}_actual"]), theory[f"{agg}_variance"])


def test_avg_estimate_is_close(sides):
    left, right = sides
    rows = estimates(sample_pair(left, right, Rates(1.0, 0.3, 0.3), REPLICATES, 6), "x").collect()
    actual = exact_join_agg(left.table, right.table, "k", "k", "x").first()["avg_actual"]
    mean = sum(r["avg_estimate"] for r in rows) / len(rows)
    assert abs(mean / actual - 1) < 0.02


@pytest.mark.parametrize("agg", ["count", "sum", "avg"])
def test_planned_rate_has_the_least_variance(found, agg):
    planned = central.sampling_rates(found, agg, 0.02, 0.01).first()["p"]
    grid = [0.02 + 0.98 * i / 400 for i in range(401)]
    curve = central.variance_curve(found, 0.02, 0.01, [planned, *grid]).collect()
    assert curve[0][f"{agg}_variance"] <= min(r[f"{agg}_variance"] for r in curve[1:]) * (1 + 1e-9)


def test_samples_keep_the_budgeted_share(sides):
    left, right = sides
    pair = sample_pair(left, right, Rates(1.0, 0.1, 0.2), 100, 7)
    assert abs(pair.left.count() / (3000 * 100) - 0.1) < 0.005
    assert abs(pair.right.count() / (900 * 100) - 0.2) < 0.01


def test_universe_keys_agree_between_sides(sides):
    left, right = sides
    pair = sample_pair(left, right, Rates(0.3, 1.0, 1.0), 20, 8)
    kept = pair.left.select("replicate", "k").distinct()
    both = kept.join(pair.right.select("replicate", "k").distinct(), ["replicate", "k"], "full").count()
    shared = left.table.select("k").distinct().intersect(right.table.select("k").distinct())
    left_only = kept.join(shared, "k", "left_anti").count()
    assert both - left_only == pair.right.select("replicate", "k").distinct().count()


def test_two_level_count_is_unbiased_within_budget(sides):
    left, right = sides
    rates = settle(two_level.key_rates(left, right, 0.3), "rates")
    sample = two_level.two_level_sample(left, right, rates, REPLICATES, 9)
    values = [r["count_estimate"] for r in two_level.two_level_count(sample).collect()]
    actual = float(exact_join_agg(left.table, right.table, "k", "k", "x").first()["count_actual"])
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
    assert abs(mean - actual) <= 4.5 * math.sqrt(spread / len(values))
    kept = (sample.left.count() + sample.right.count()) / REPLICATES
    assert abs(kept / (0.3 * 3000) - 1) < 0.1


def test_two_level_sample_has_one_sentry_per_kept_key(sides):
    left, right = sides
    rates = settle(two_level.key_rates(left, right, 0.3), "rates")
    sample = two_level.two_level_sample(left, right, rates, 5, 10)
    per_key = sample.left.groupBy("replicate", "k").agg(F.count_if("is_sentry").alias("n"))
    assert per_key.where("n <> 1").count() == 0
    assert sample.left.groupBy("replicate", "row").count().where("count > 1").count() == 0


def test_grouped_estimates_are_unbiased(sides):
    left, right = sides
    stats = key_stats(left.table, "k", "x", ["grp"])
    profile = settle(left.table.groupBy("grp").agg(F.count("*").cast("double").alias("n_rows"), F.countDistinct("k").cast("double").alias("n_keys")), "profile")
    pooled = central.pooled_rates(moments(stats, key_counts(right.table, "k"), ["grp"]), "count", 0.3, 0.4)
    key_t = profile.agg(F.max("n_keys").alias("t")).first()["t"]
    parameters = strata.group_parameters(strata.proportional_rates(profile, key_t, 50, 0.3), pooled, 0.4)
    sample = stratified.universe_strata_pair(left, right, "grp", parameters, REPLICATES, 11)
    check_groups(stratified.universe_strata_estimates(sample, "x"), left, right)


def test_fixed_size_groups_are_unbiased(sides):
    left, right = sides
    sample = stratified.fixed_size_strata_pair(left, right, "grp", 200, 0.25, REPLICATES, 12)
    check_groups(stratified.fixed_size_strata_estimates(sample, "x"), left, right)
    assert sample.left.groupBy("replicate", "grp").count().where("count > 200 and grp in (select max(grp) from values 9 t(grp))").count() == 0


def check_groups(found, left, right):
    actual = {r["grp"]: r for r in exact_join_agg(left.table, right.table, "k", "k", "x", by="grp").collect()}
    summed = found.groupBy("grp").agg(
        *[F.avg(f"{a}_estimate").alias(a) for a in ("count", "sum")],
        *[F.stddev_samp(f"{a}_estimate").alias(f"{a}_sd") for a in ("count", "sum")],
        F.count("*").alias("n"),
    )
    rows = summed.collect()
    assert {r["grp"] for r in rows} == set(actual)
    for r in rows:
        assert r["n"] == REPLICATES
        for a in ("count", "sum"):
            assert abs(r[a] - float(actual[r["grp"]][f"{a}_actual"])) <= 4.5 * r[f"{a}_sd"] / math.sqrt(REPLICATES)


def test_sketched_join_size_is_close(sides):
    left, right = sides
    exact = float(exact_join_agg(left.table, right.table, "k", "k", "x").first()["count_actual"])
    sketched = sketches.sketched_join_size(key_counts(left.table, "k", "a"), key_counts(right.table, "k"), 1000, 13)
    assert abs(sketched.first()["n_join"] / exact - 1) < 0.35


def test_bucketed_sketches_are_as_close_as_theory_says(spark):
    """At 1000 counters: the median over five rows of 200 buckets, over many seeds, against the spread of one row."""
    left = spark.range(4000).select(F.col("id").alias("key"), (1 + F.col("id") % 7).cast("double").alias("a"))
    right = spark.range(1000, 5000).select(F.col("id").alias("key"), (1 + F.col("id") % 5).cast("double").alias("b"))
    exact = left.join(right, "key").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    norms = [df.agg(F.sum(F.pow(c, F.lit(2)))).first()[0] for df, c in ((left, "a"), (right, "b"))]
    sigma = ((norms[0] * norms[1] + exact**2) / sketches.WIDTH) ** 0.5
    found = [sketches.bucketed_join_size(left, right, seed=i).first()["n_join"] for i in range(12)]
    assert abs(sum(found) / 12 - exact) < 4 * sigma / 12**0.5
    assert sum((f - exact) ** 2 for f in found) / 12 < 1.5 * sigma**2
    assert all(abs(f - exact) < 4 * sigma for f in found)


def test_bucketed_sketches_add_up(spark):
    stats = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 9).cast("double").alias("a"))
    whole = sketches.bucket_sketch(stats, {"u": F.col("a")}, 16, 3, 2)
    parts = [sketches.bucket_sketch(stats.where(f"key % 3 = {i}"), {"u": F.col("a")}, 16, 3, 2) for i in range(3)]
    merged = sketches.merged_sketches(*parts)
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()
    empty = sketches.bucketed_join_size(stats.where("false"), stats.withColumnRenamed("a", "b")).first()
    assert empty["n_join"] == 0.0


def test_preset_sweep_draws_presets_together(sides):
    left, right = sides
    presets = [Rates.preset(0.3, 0.4), Rates.preset(1.0, 0.2)]
    together = sample_pair(left, right, presets, 4, 14)
    for i, rates in enumerate(presets):
        alone = sample_pair(left, right, rates, 4, 14).left.select("replicate", "row")
        assert together.left.where(F.col("preset") == i).select("replicate", "row").exceptAll(alone).count() == 0
        assert alone.count() == together.left.where(F.col("preset") == i).count()


def test_metrics_of_a_run(sides, spark):
    left, right = sides
    actual = exact_join_agg(left.table, right.table, "k", "k", "x")
    pair = sample_pair(left, right, Rates(1.0, 0.3, 0.3), 50, 15)
    rows = runs.results(estimates(pair, "x"), actual, "l", "r", {})
    found = {r["query"]: r for r in metrics.summary(rows, ["query"]).collect()}
    assert found["count"]["n_runs"] == 50
    assert 0 < found["count"]["mean_percent_error"] < 30


@pytest.mark.parametrize("rate", [1e-7, 1e-8, 1e-9, 1e-10])
def test_kept_share_is_the_rate_however_small(spark, rate):
    """Coefficients that make ``h`` the upper bits; ``tie`` changes the lower ones only. The kept share over both."""
    steps = 1000
    every = spark.range(300).withColumnRenamed("id", "h").crossJoin(spark.range(steps).withColumnRenamed("id", "tie"))
    draw = lambda name: F.lit(int(name == "row_1")).cast("long")
    kept = every.where(sampling.hash_below(every, ["h", "tie"], "row", draw, F.lit(rate))).count() / steps
    at_border = rate * PRIME % 1
    assert abs(kept - rate * PRIME) <= 4 * (at_border * (1 - at_border) / steps) ** 0.5


def test_rates_of_zero_one_and_none(spark):
    every = spark.range(1000)
    draw = lambda name: F.lit(12345 + len(name)).cast("long")
    kept = lambda rate: every.where(sampling.hash_below(every, ["id"], "row", draw, rate)).count()
    assert [kept(F.lit(r)) for r in (0.0, 1.0, 1.5)] == [0, 1000, 1000]
    assert kept(F.lit(None).cast("double")) == 0


def test_equal_ranks_do_not_fall_to_row_order(spark, monkeypatch):
    """Where the upper bits are the same for all rows, the lower ones rank them, differently in each replicate."""
    monkeypatch.setattr(hashing, "polynomial_hash", lambda parts, coefficient: F.lit(0).cast("long"))
    left = Side(spark.range(200).select(F.col("id").alias("row"), F.lit(1).alias("g"), F.col("id").alias("k")), "k", ("row",))
    drawn = stratified.fixed_size_strata_pair(left, left, "g", 5, 0.001, replicates=20)
    assert drawn.left.count() == 100
    assert drawn.left.select("row").distinct().count() > 50


def test_replicates_are_independent(spark):
    """Hits of a key over 1000 replicates are binomial in all four moments."""
    n, p, keys = 1000, 0.01, 4000
    side = Side(spark.range(keys).select((F.col("id") * 7 + 3).alias("k")), "k", ("k",))
    hits = sampling.universe_sample(side, p, n, 21).groupBy("k").count()
    every = side.table.join(hits, "k", "left").fillna(0, ["count"])
    row = every.agg(F.avg("count"), F.var_samp("count"), F.kurtosis("count"), F.avg((F.col("count") == 0).cast("int")), F.max("count")).first()
    assert abs(row[0] - n * p) < 4 * (n * p / keys) ** 0.5
    assert abs(row[1] / (n * p * (1 - p)) - 1) < 0.1
    assert abs(row[2] + 3 - 3.1) < 0.4
    assert row[3] < 0.002 and row[4] < 35


def test_coefficients_are_the_same_on_the_driver_and_in_plans(spark):
    draws = hashing.Draws(9, (1, 2, 77), {"key": 5, "left_first": 5})
    table = spark.createDataFrame([(r,) for r in draws.replicates], "replicate int")
    for role, n in draws.roles.items():
        found = table.select("replicate", *[draws.coefficient(f"{role}_{i}").alias(f"c{i}") for i in range(n)]).collect()
        assert {r[0]: list(r)[1:] for r in found} == {r: hashing.draw_coefficients(9, role, r, n) for r in draws.replicates}


def largest_method(df):
    """Bytes of the longest method that whole-stage code generation makes for a plan."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.mark.parametrize("kind", ["s03_preset_sweep", "s08_fixed_size_strata_pair", "s09_two_level_left", "s10_universe_strata_left", "e05_preset_estimates", "e06_swept_estimates_at_least"])
def test_scans_are_short_enough_to_be_compiled(spark, folder, kind):
    """The JVM interprets methods of more than 8000 bytes."""
    from catalogue import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = {name: largest_method(run(spark, folder)) for name, run in QUERIES.items() if name == kind}
        assert sizes and all(size <= 8000 for size in sizes.values()), sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(("fan", "ranked", "limit"), [(1024, 10_000, 7), (4, 3, 7), (2, 1, 1), (16, 5, 400), (1024, 1, 5000)])
def test_smallest_rows_of_groups_are_found_by_counting(spark, monkeypatch, fan, ranked, limit):
    monkeypatch.setattr(stratified, "FAN", fan)
    monkeypatch.setattr(stratified, "RANKED", ranked)
    group = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 50 == 1, "small").otherwise("large")
    rank = F.when(F.col("id") % 7 == 0, F.lit(123456789)).otherwise(F.pmod(F.xxhash64("id"), F.lit(hashing.RANGE)))
    rows = settle(spark.range(3000).select(group.alias("g"), F.col("id").alias("row"), rank.alias("r")), "ranked-rows")
    found = stratified.smallest(rows, ["g"], "r", ("row",), limit)
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["g"], []).append((r["r"], r["row"]))
    want = sorted((str(g), row) for g, held in by_group.items() for _, row in sorted(held)[:limit])
    assert sorted((str(r["g"]), r["row"]) for r in found.collect()) == want


def test_only_the_edge_of_a_group_is_ranked(spark, monkeypatch):
    """A group's 20,000 rows of a sample: the ranking sees no more than a few."""
    monkeypatch.setattr(stratified, "RANKED", 100)
    seen = []
    settle_ = stratified.settle
    monkeypatch.setattr(stratified, "settle", lambda df, name: seen.append((name, settle_(df, name))) or seen[-1][1])
    rows = settle_(spark.range(40_000).select(F.lit(1).alias("g"), F.col("id").alias("row"), F.pmod(F.xxhash64("id"), F.lit(hashing.RANGE)).alias("r")), "ranked-rows")
    assert stratified.smallest(rows, ["g"], "r", ("row",), 20_000).count() == 20_000
    last = [df for name, df in seen if name == "rank-bounds"][-1].first()
    assert last["_in"] <= 100 and last["_before"] < 20_000 <= last["_before"] + last["_in"]


def test_sums_above_a_block_are_scanned(spark, monkeypatch):
    """Many blocks per draw: no row holds them all, and the sums are right."""
    monkeypatch.setattr(sweep, "BLOCK", 4)
    left = spark.range(500).select((F.col("id") % 13).alias("k"), F.col("id").alias("v"), F.lit(1.0).alias("x"))
    right = spark.range(13).select(F.col("id").alias("k"))
    found = {r["value"]: r["count_actual"] for r in sweep.sweep_answers(left, right, "k", "k", "x", "v", 3, ">=").collect()}
    assert found == {v: 500.0 - v for v in range(0, 500, 3)}
    plan = sweep.sweep_answers(left, right, "k", "k", "x", "v", 3, ">=")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan
