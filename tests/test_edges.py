"""Edge cases: empty samples, NULLs, one-sided keys, negative measures, zero sums, hot keys, plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thinjoin import Rates, approx_join_agg, estimates, exact_join_agg, key_counts, key_stats, moments, sample_pair
from thinjoin.evaluation import runs
from thinjoin.functions import predicates
from thinjoin.functions.hashing import PRIME
from thinjoin.operators import keystats, stratified, sweep, two_level
from thinjoin.operators.sampling import Side, bernoulli_sample, fixed_rates, universe_sample
from thinjoin.plans import central, decentral, strata
from thinjoin.session import new_path
from thinjoin.sources import catalog, synthetic, tables


def sides(spark, left_rows, right_rows):
    left = spark.createDataFrame(left_rows, "k bigint, row bigint, x double, grp string")
    right = spark.createDataFrame(right_rows, "k bigint, row bigint")
    return Side(left, "k", ("row",)), Side(right, "k", ("row",))


@pytest.fixture(scope="module")
def small(spark):
    left = [(1, 1, 2.0, "a"), (1, 2, None, "a"), (2, 3, -4.0, "b"), (None, 4, 9.0, "b"), (3, 5, 7.0, None), (5, 6, 1.0, "b")]
    right = [(1, 1), (1, 2), (2, 3), (4, 4), (None, 5), (3, 6)]
    return sides(spark, left, right)


def test_exact_answers_with_nulls_and_one_sided_keys(small):
    left, right = small
    row = exact_join_agg(left.table, right.table, "k", "k", "x").first()
    assert (row["count_actual"], row["sum_actual"]) == (6.0, 7.0)
    assert row["avg_actual"] == pytest.approx(7 / 4)


def test_full_sample_gives_the_exact_answer(small):
    left, right = small
    row = estimates(sample_pair(left, right, Rates(1.0, 1.0, 1.0), 2, 1), "x").first()
    assert (row["count_estimate"], row["sum_estimate"]) == (6.0, 7.0)
    assert row["avg_estimate"] == pytest.approx(7 / 4)


def test_empty_sample_estimates_zero(small):
    left, right = small
    rows = estimates(sample_pair(left, right, Rates(1e-9, 1.0, 1.0), 3, 1), "x").collect()
    assert [r["count_estimate"] for r in rows] == [0.0] * 3
    assert [r["avg_estimate"] for r in rows] == [0.0] * 3


def test_group_key_may_be_null(small):
    left, right = small
    found = {r["grp"]: r["count_actual"] for r in exact_join_agg(left.table, right.table, "k", "k", "x", by="grp").collect()}
    assert found == {"a": 4.0, "b": 1.0, None: 1.0}


def test_grouped_estimates_report_missed_groups(small):
    left, right = small
    sample = stratified.fixed_size_strata_pair(left, right, "grp", 10, 1.0, 1, 1)
    rows = {r["grp"]: r for r in stratified.fixed_size_strata_estimates(sample, "x").collect()}
    assert rows["a"]["count_estimate"] == 4.0 and rows[None]["count_estimate"] == 1.0
    tiny = stratified.fixed_size_strata_pair(left, right, "grp", 1, 1e-6, 1, 1)
    missed = stratified.fixed_size_strata_estimates(tiny, "x").collect()
    assert len(missed) == 3 and all(r["count_estimate"] == 0 and not r["seen"] for r in missed)


def test_empty_join_has_a_status_and_no_rate(spark):
    left, right = sides(spark, [(1, 1, 1.0, "a")], [(2, 1)])
    found = moments(key_stats(left.table, "k", "x"), key_counts(right.table, "k"))
    row = central.sampling_rates(found, "count", 0.1, 0.1).first()
    assert (row["status"], row["p"]) == ("empty join", None)
    with pytest.raises(ValueError, match="empty join"):
        fixed_rates(central.sampling_rates(found, "count", 0.1, 0.1))


def test_cancelling_measure_has_a_status(spark):
    left, right = sides(spark, [(1, 1, 1.0, "a"), (1, 2, -1.0, "a")], [(1, 1)])
    found = moments(key_stats(left.table, "k", "x"), key_counts(right.table, "k"))
    assert central.sampling_rates(found, "avg", 0.1, 0.1).first()["status"] == "sum is zero"
    assert central.sampling_rates(found, "sum", 0.1, 0.1).first()["p"] is not None


def test_single_row_keys_have_zero_variance(spark):
    table = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "k bigint, x double")
    rows = {r["key"]: r["variance"] for r in keystats.key_mean_variance(table, "k", "x").collect()}
    assert rows == {1: 0.0, 2: 2.0}


def test_uneven_budgets_keep_rates_below_one(spark):
    left, right = sides(spark, [(i % 3, i, 1.0, "a") for i in range(60)], [(i % 3, i) for i in range(30)])
    found = moments(key_stats(left.table, "k", "x"), key_counts(right.table, "k"))
    for agg in ("count", "sum", "avg"):
        row = central.sampling_rates(found, agg, 0.3, 0.05).first()
        assert 0.3 <= row["p"] <= 1 and row["q1"] <= 1 + 1e-12 and row["q2"] <= 1


def test_string_and_negative_keys_are_sampled(spark):
    table = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), (-F.col("id")).alias("row"))
    side = Side(table, "k", ("row",))
    assert 0.07 < universe_sample(side, 0.1, 1, 3).count() / 4000 < 0.13
    assert 0.07 < bernoulli_sample(side, 0.1, 1, 3).count() / 4000 < 0.13


def test_keys_beyond_31_bits_are_told_apart(spark):
    table = spark.range(2000).select((F.col("id") * F.lit(2**31)).alias("k"), F.col("id").alias("row"))
    assert 700 < universe_sample(Side(table, "k", ("row",)), 0.5, 1, 4).count() < 1300


def test_samples_do_not_depend_on_partitioning(spark):
    table = spark.range(5000).select((F.col("id") % 50).alias("k"), F.col("id").alias("row"))
    one = bernoulli_sample(Side(table, "k", ("row",)), 0.2, 2, 5)
    other = bernoulli_sample(Side(table.repartition(13), "k", ("row",)), 0.2, 2, 5)
    assert one.exceptAll(other).count() == 0 and one.count() == other.count()


def test_physical_row_identity_tells_equal_rows_apart(spark):
    path = new_path(spark, "copies")
    spark.range(2000).select(F.lit(1).alias("k"), F.lit(2).alias("x")).repartition(4).write.parquet(path)
    table = tables.with_row_id(spark, path)
    assert table.select("row_id").distinct().count() == 2000
    kept = bernoulli_sample(Side(table, "k", ("row_id",)), 0.3, 1, 6)
    assert 450 < kept.count() < 750
    assert kept.count() == bernoulli_sample(Side(tables.with_row_id(spark, path), "k", ("row_id",)), 0.3, 1, 6).count()


def test_hot_key_counts_do_not_overflow(spark):
    hot = spark.createDataFrame([(1, 4e9, 4e9, 4e12, 4e15)], "key bigint, a double, x double, s double, q double")
    right = spark.createDataFrame([(1, 3e9)], "key bigint, b double")
    row = moments(hot, right).first()
    assert row["a2b2"] == pytest.approx(1.44e38)
    planned = central.sampling_rates(moments(hot, right), "count", 0.01, 0.01).first()
    assert planned["p"] == 1.0


def test_decentral_sum_rate_is_the_minimax(spark):
    stats = spark.createDataFrame(
        [(1, 100.0, 100.0, 1000.0, 10100.0), (2, 60.0, 60.0, 500.0, 40000.0), (3, 1.0, 1.0, 2.0, 4.0)],
        "key bigint, a double, x double, s double, q double",
    )
    right = spark.range(500)
    e1, e2, n = 0.02, 0.01, 500.0
    row = decentral.sum_rates(stats, right, e1, e2).first()

    def worst(p):
        w = (1 / p - 1, 1 / e2 - 1 / p, 1 / e1 - 1 / p, p / (e1 * e2) - 1 / e1 - 1 / e2 + 1 / p)
        keys = ((1000.0**2, 10100.0), (500.0**2, 40000.0))
        return max(w[0] * s2 * n * n + w[1] * s2 * n + w[2] * q * n * n + w[3] * q * n for s2, q in keys)

    grid = [e1 + (1 - e1) * i / 5000 for i in range(5001)]
    assert row["worst"] == pytest.approx(worst(row["p"]))
    assert row["worst"] <= min(map(worst, grid)) * (1 + 1e-9)


def test_two_level_search_finds_the_minimum(spark):
    left, right = sides(
        spark, [(i % 7 if i % 3 else 0, i, 1.0, "a") for i in range(200)], [(i % 7, i) for i in range(90)]
    )
    pairs = two_level.frequency_pairs(left.table, right.table, "k", "k")
    found = two_level.row_rate(pairs, left.table, 0.2).first()
    rows = [(r["a"], r["b"], r["n_keys"]) for r in pairs.collect()]

    def total(q):
        value = 0.0
        for a, b, n in rows:
            x = (1 / q**2 - 1) * (a - 1) * (b - 1) + (1 / q - 1) * ((b - 1) * (a * a - a + 1) + (a - 1) * (b * b - b + 1))
            value += n * ((max(x, 0) + a * a * b * b) * (2 + q * (a + b - 2))) ** 0.5
        return value

    best = min(total(i / 2000) for i in range(2, 2001))
    assert found["total"] <= best * 1.001
    assert found["c"] * found["total"] == pytest.approx(0.2 * 200)


def test_keys_with_one_row_on_each_side(spark):
    left, right = sides(spark, [(i, i, 1.0, "a") for i in range(50)], [(i, i) for i in range(50)])
    rates = two_level.key_rates(left, right, 3.0)
    assert rates.where("p < 1 or q <> 1").count() == 0


def test_infeasible_group_budget_has_a_status(spark):
    profile = spark.createDataFrame([("a", 100.0, 50.0), ("b", 10.0, 2.0)], "grp string, n_rows double, n_keys double")
    rows = {r["grp"]: r for r in strata.proportional_rates(profile, 10, 5, 0.1).collect()}
    assert rows["a"]["status"] == "ok" and rows["a"]["rate"] == pytest.approx(0.1)
    assert rows["b"]["status"] == "budget exceeded" and rows["b"]["rate"] is None


def test_rebalanced_rates_without_short_groups(spark):
    profile = spark.createDataFrame([("a", 100.0, 50.0)], "grp string, n_rows double, n_keys double")
    assert strata.rebalanced_rates(profile, 10, 1, 0.1).first()["rate"] == pytest.approx(0.05)


def test_swept_moments_equal_filtered_moments(spark):
    rows = spark.range(400).select(
        (F.col("id") % 9).alias("k"), (F.col("id") % 23 + 3).alias("w"), ((F.col("id") * 31) % 17 - 8).cast("double").alias("x")
    )
    for op in (">=", "="):
        swept = {r["value"]: r for r in sweep.sweep_moments(rows, rows, "k", "k", "x", "w", 4, op).collect()}
        assert sorted(swept) == list(range(3, 26, 4))
        for value, row in swept.items():
            kept = rows.where(predicates.compare("w", op, value))
            alone = moments(key_stats(kept, "k", "x"), key_counts(rows, "k")).first()
            for name in alone.asDict():
                assert row[name] == pytest.approx(alone[name], rel=1e-9, abs=1e-6)


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        predicates.compare("x", "~", 1)
    with pytest.raises(ValueError):
        synthetic.synthetic_table(synthetic.row_numbers(spark, 1), F.lit(5), "zipf", 1)


def test_merge_keeps_null_keys_once(spark):
    stored = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0)], "query string, idx int, estimate double")
    pending = spark.createDataFrame([("a", None, 9.0), ("a", 2, 3.0)], "query string, idx int, estimate double")
    rows = runs.merged_results(stored, pending, ["query", "idx"]).collect()
    assert sorted(r["estimate"] for r in rows) == [1.0, 2.0, 3.0]


def test_filters_hold_for_planning_and_sampling(small):
    left, right = small
    rows = approx_join_agg(left, right, "x", "count", 1.0, 1.0, 1, 1, predicates.compare("grp", "=", "a")).collect()
    assert rows[0]["estimate"] == 4.0


def test_stored_pair_resumes(spark, small):
    left, right = small
    path, identity = new_path(spark, "pair"), dict.fromkeys(catalog.META_IDENTITY, "t")
    full = Rates(1.0, 1.0, 1.0)
    catalog.store_pair(left, right, full, path, 2, identity)
    assert catalog.missing_replicates(spark, path, 4, identity, full) == [3, 4]
    assert catalog.missing_replicates(spark, path, 2, identity, full, seed=2) == [1, 2]
    assert catalog.missing_replicates(spark, path, 2, identity, Rates(0.5, 1.0, 1.0)) == [1, 2]
    assert catalog.missing_replicates(spark, path, 2, identity | {"agg": "other"}, full) == [1, 2]
    meta = catalog.store_pair(left, right, full, path, 4, identity)
    assert meta.count() == 4
    pair = catalog.load_pair(left, right, path, 4, identity)
    assert pair.rates == full
    assert pair.left.groupBy("replicate").count().count() == 4
    with pytest.raises(ValueError):
        catalog.load_pair(left, right, path, 5, identity)
    with pytest.raises(ValueError):
        catalog.load_pair(left, right, path, 2, identity, rates=Rates(0.5, 1.0, 1.0))


def test_overwritten_pair_keeps_nothing_old(spark, small):
    left, right = small
    path, identity = new_path(spark, "pair"), dict.fromkeys(catalog.META_IDENTITY, "t")
    presets = [Rates(1.0, 1.0, 1.0), Rates(1.0, 0.5, 0.5)]
    catalog.store_pair(left, right, presets, path, 3, identity)
    meta = catalog.store_pair(left, right, presets, path, 3, identity, overwrite=True)
    assert meta.count() == 6
    pair = catalog.load_pair(left, right, path, 3, identity)
    assert list(pair.rates) == presets
    rows = pair.left.where("preset = 0").groupBy("replicate").count().collect()
    assert {r["count"] for r in rows} == {left.table.where(F.col(left.key).isNotNull()).count()}


def test_stored_statistics_tell_inputs_apart(spark, small):
    left, right = small
    path = new_path(spark, "stats")
    spark.range(3).write.parquet(f"{path}/stats-broken")  # what a run that died may leave
    one = catalog.stored_key_stats(left.table, left.key, None, path)
    two = catalog.stored_key_stats(right.table, right.key, None, path)
    again = catalog.stored_key_stats(left.table, left.key, None, path)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, key_counts(right.table, right.key).collect()))


def test_samplers_work_on_streams(spark):
    source, target = new_path(spark, "stream"), new_path(spark, "thinned")
    table = spark.range(2000).select((F.col("id") % 40).alias("k"), F.col("id").alias("row"))
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    thinned = universe_sample(Side(stream, "k", ("row",)), 0.3, 1, 9)
    run = thinned.writeStream.format("parquet").option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start(target)
    run.awaitTermination(60)
    batch = universe_sample(Side(spark.read.parquet(source), "k", ("row",)), 0.3, 1, 9)
    assert spark.read.parquet(target).count() == batch.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sampling_needs_no_shuffle_and_reads_only_used_columns(spark, folder):
    from catalogue.common import event_side, order_side

    pair = sample_pair(event_side(spark, folder), order_side(spark, folder), Rates(0.5, 0.1, 0.1), 20, 1)
    plan = plan_of(pair.left)
    assert "Exchange" not in plan and "Join" not in plan
    counts = plan_of(key_counts(spark.read.parquet(f"{folder}/orders.parquet"), "o_custkey"))
    assert "FileScan parquet [o_custkey" in counts and "o_totalprice" not in counts


def test_statistics_join_reuses_the_aggregates_partitioning(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.read.parquet(f"{folder}/lineitem.parquet")
        orders = spark.read.parquet(f"{folder}/orders.parquet")
        found = moments(key_stats(lines, "l_orderkey", "l_quantity"), key_counts(orders, "o_orderkey"))
        assert plan_of(found).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_values_stay_in_range(spark):
    from thinjoin.functions.hashing import Draws, coefficients_needed, hash_parts, polynomial_hash

    table = spark.range(1000).select(((F.col("id") - 500) * F.lit(9_000_000_000_000_000)).alias("k"))
    fanned, draw = Draws(1, (1, 2), {"key": coefficients_needed(1)}).attach(table)
    value = polynomial_hash(hash_parts(table, ["k"]), lambda i: draw(f"key_{i}"))
    row = fanned.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    assert 0 <= row["low"] and row["high"] < PRIME


def test_skewed_join_matches_a_plain_join(spark):
    from thinjoin.operators.skew import hot_keys, join_by_key
    from thinjoin.session import settle

    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 4001).alias("k"),
        F.col("id").alias("row"),
    )
    small = settle(
        spark.range(0, 4001, 5).select(F.col("id").alias("sk"), F.explode(F.array(F.lit(1), F.lit(2))).alias("draw")).unionByName(
            spark.createDataFrame([(None, 1)], "sk bigint, draw int")
        ),
        "small",
    )
    assert {r["_hot_key"] for r in hot_keys(big, "k").collect()} == {5, None}
    plain = big.join(small, big["k"].eqNullSafe(small["sk"]))
    split = join_by_key(big, "k", small, "sk", broadcast_bytes=0)
    assert plain.count() == split.count()
    assert plain.exceptAll(split.select(*plain.columns)).count() == 0


def test_fixed_size_sample_does_not_depend_on_the_candidate_bound(spark):
    left = spark.range(3000).select((F.col("id") % 11).alias("k"), F.col("id").alias("row"), F.lit(1.0).alias("x"), (F.col("id") % 3).alias("grp"))
    right = spark.range(50).select((F.col("id") % 11).alias("k"), F.col("id").alias("row"))
    sides_ = Side(left, "k", ("row",)), Side(right, "k", ("row",))
    wide = stratified.fixed_size_strata_pair(*sides_, "grp", 150, 0.01, 2, 3)
    short = stratified.fixed_size_strata_pair(*sides_, "grp", 150, 0.01, 2, 3, slack=-5.0)
    assert wide.left.count() == 2 * 3 * 150
    assert wide.left.exceptAll(short.left).count() == 0 and short.left.count() == 900


def test_two_level_sample_with_many_keys_matches_the_broadcast_one(spark, monkeypatch):
    from thinjoin.operators import skew

    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 300).alias("k"), F.col("id").alias("row"))
    right = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("row"))
    one, two = Side(left, "k", ("row",)), Side(right, "k", ("row",))
    rates = two_level.key_rates(one, two, 0.2)
    broadcast = two_level.two_level_sample(one, two, rates, 2, 5)
    monkeypatch.setattr(two_level, "fits_broadcast", lambda stored: False)
    monkeypatch.setattr(skew.join_by_key, "__defaults__", (None, 0))
    split = two_level.two_level_sample(one, two, rates, 2, 5)
    for name in ("left", "right"):
        a, b = getattr(broadcast, name), getattr(split, name)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_text_schemas(spark):
    from thinjoin.sources import text

    path = new_path(spark, "orders-text")
    spark.createDataFrame([("1,7,prior,3,2,11,15.5",), ("2,7,train,4,0,1,",)], "value string").write.text(path)
    rows = text.scan_text(spark, path, text.SCHEMAS["orders"], ",").orderBy("order_id").collect()
    assert str(rows[0]["days_since_prior"]) == "15.5" and rows[1]["days_since_prior"] is None
    assert rows[0]["eval_set"] == "prior"
    for schema in text.SCHEMAS.values():
        assert text.scan_text(spark, path, schema, ",").columns


def test_no_registered_plan_multiplies_rows_or_leaves_the_jvm(spark, folder):
    """A few of each family; nested-loop joins and Python evaluation have no place in any of them."""
    import __spark_entry__ as entry

    names = ("a08_moments", "e01_sampled_count", "e05_preset_estimates", "e06_swept_estimates_at_least", "e08_universe_strata_estimates",
             "e09_fixed_size_strata_estimates", "e10_two_level_count", "n09_predicate_rate_count_at_least_identical", "v08_summary")
    for name in names:
        plan = plan_of(entry.queries()[name](spark, folder))
        for operator in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python"):
            assert operator not in plan, (name, operator)


@pytest.mark.parametrize("frequency", [1e3, 1e5, 1e7])
def test_two_level_rate_is_the_best_at_any_frequency(spark, frequency):
    """Against a search that shares nothing with the planner's grid."""
    import numpy as np

    counts = [(frequency, frequency, 50.0), (frequency / 7, frequency * 2, 20.0), (3.0, 2.0, 100.0)]
    pairs = spark.createDataFrame(counts, "a double, b double, n_keys double")
    found = two_level.row_rate(pairs, spark.range(10), 0.1).first()

    def total(q):
        value = 0.0
        for a, b, n in counts:
            x = (1 / q**2 - 1) * (a - 1) * (b - 1) + (1 / q - 1) * ((b - 1) * (a * a - a + 1) + (a - 1) * (b * b - b + 1))
            value = value + n * np.sqrt((np.maximum(x, 0) + a * a * b * b) * (2 + q * (a + b - 2)))
        return value

    best = total(np.exp(-np.linspace(0, 20, 400_001))).min()
    assert found["total"] <= 1.0001 * best
    assert found["total"] == pytest.approx(total(found["q"]), rel=1e-9)


@pytest.mark.parametrize(
    "left_type, right_type", [("int", "bigint"), ("bigint", "decimal(18,0)"), ("date", "timestamp"), ("bigint", "string"), ("float", "double")]
)
def test_keys_of_different_types_are_sampled_together(spark, left_type, right_type):
    def keyed(kind, rows):
        number = (F.col("id") % 400).cast("int")
        value = F.date_add(F.lit("2020-01-01").cast("date"), number) if kind in ("date", "timestamp") else number
        return Side(spark.range(rows).select(value.cast(kind).alias("k"), F.col("id").alias("row")), "k", ("row",))

    left, right = keyed(left_type, 4000), keyed(right_type, 2000)
    pair = sample_pair(left, right, Rates(0.2, 1.0, 1.0), 40, 5)
    counts = [r["count_estimate"] for r in estimates(pair, "row").collect()]
    exact = 4000 * 2000 / 400
    assert len(counts) == 40
    assert abs(sum(counts) / 40 - exact) < 4 * exact * (0.8 / 0.2 / 400 / 40) ** 0.5


def test_keys_that_cannot_be_joined_are_refused(spark):
    left = Side(spark.sql("SELECT map(1, 2) AS k, 1 AS row"), "k", ("row",))
    right = Side(spark.sql("SELECT 1 AS k, 1 AS row"), "k", ("row",))
    with pytest.raises(ValueError):
        sample_pair(left, right, Rates(1.0, 1.0, 1.0))


def test_grouped_results_keep_answers_without_estimate(spark):
    from thinjoin.functions.hashing import Draws

    names = "count_{0} double, sum_{0} double, avg_{0} double"
    actual = spark.createDataFrame([("a", 1.0, 2.0, 2.0), ("b", 3.0, 3.0, 1.0), (None, 5.0, 5.0, 1.0)], "grp string, " + names.format("actual"))
    found = [(0, 1, "a", 1.5, 2.5, 2.0), (0, 1, None, 4.0, 4.0, 1.0), (0, 2, "b", None, None, None)]
    estimated = spark.createDataFrame(found, "preset int, replicate int, grp string, " + names.format("estimate"))
    rows = runs.results(estimated, actual, "l", "r", {}, ["grp"], Draws(1, (1, 2), {})).where("query = 'count'").collect()
    got = {(r["idx"], r["grp"]): r["estimate"] for r in rows}
    assert got == {(1, "a"): 1.5, (1, "b"): 0.0, (1, None): 4.0, (2, "a"): 0.0, (2, "b"): None, (2, None): 0.0}


def test_relabelled_tables_meet_as_independent_ones(spark):
    """Over seeds, the join of two normally distributed tables has about n1 * n2 / K rows."""
    from thinjoin.functions import variates

    n, keys = 20_000, 5_000
    ratios = []
    for seed in range(6):
        sides = []
        for side in (1, 2):
            drawn = variates.keys(F.col("id"), 10 * seed + side, "normal2", F.lit(keys))
            sides.append(spark.range(n).select(variates.relabel(drawn, F.lit(keys), 10 * seed + side).alias("k")))
        assert sides[0].agg(F.min("k") >= 1, F.max("k") <= keys).first() == (True, True)
        ratios.append(sides[0].join(sides[1], "k").count() / (n * n / keys))
    assert 0.7 < sum(ratios) / len(ratios) < 1.3


def test_sweep_runs_in_blocks(spark, small, monkeypatch):
    """Blocks of two values give what one block gives, and no window gathers all values in one task."""
    left, right = small
    arguments = (left.table, right.table, left.key, right.key, "x", "x", 1, ">=")
    whole = sorted(map(tuple, sweep.sweep_answers(*arguments).collect()))
    monkeypatch.setattr(sweep, "BLOCK", 2)
    found = sweep.sweep_answers(*arguments)
    assert sorted(map(tuple, found.collect())) == whole
    assert "Exchange SinglePartition" not in "".join(line for line in plan_of(found).split("\n") if "Window" in line)
    values = sweep.sweep_values(spark.sql("SELECT 0L AS low, 9L AS high"), 2)
    assert sorted(r["value"] for r in values.collect()) == [0, 2, 4, 6, 8]


def test_thousands_of_replicates_are_planned_at_once(spark, small):
    import time

    left, right = small
    presets = [Rates(0.5, q, q) for q in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)]
    started = time.time()
    pair = sample_pair(left, right, presets, 2000, 3)
    plan_of(pair.left)
    assert time.time() - started < 2
    shares = pair.left.groupBy("preset").count().collect()
    assert len(shares) == 6
    assert pair.draw_table().count() == 12000
    few = sample_pair(left, right, presets, [5, 1990], 3)
    same = pair.left.where("replicate in (5, 1990)")
    assert sorted(map(str, few.left.collect())) == sorted(map(str, same.collect()))


def test_joins_of_more_rows_than_a_double_can_count(spark):
    """A key with 100,000,019 and 100,000,007 rows, from counted statistics: 10^16 joined rows and their sum to the last digit."""
    from thinjoin.operators.exact import joined_sums

    one, two = 100_000_019, 100_000_007
    shared = spark.createDataFrame([(one, one, one * 3 + 1, two), (1, 1, 1, 1)], "a long, x long, s long, b long")
    shared = shared.withColumn("s", F.col("s").cast("decimal(29,0)"))
    row = shared.agg(*joined_sums(shared)).first()
    assert one * two + 1 > 2**53 and (int(row["n_join"]), int(row["s_join"])) == (one * two + 1, (one * 3 + 1) * two + 1)
    left = spark.range(60).select((F.col("id") % 3).alias("k"), F.lit(2**61 + 1).alias("x"))
    found = exact_join_agg(left, left, "k", "k", "x").first()
    assert (int(found["count_actual"]), int(found["sum_actual"])) == (1200, 1200 * (2**61 + 1))
    none = exact_join_agg(left, left.where("false"), "k", "k", "x").first()
    assert tuple(none) == (0, 0, 0.0)
