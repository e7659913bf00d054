"""Scans, predicates, joins, statistics and exact answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.registry import events, query, table
from thinjoin.functions import predicates
from thinjoin.functions.hashing import Draws, coefficients_needed, hash_parts, polynomial_hash, unit_interval
from thinjoin.functions.rates import clamp_rate
from thinjoin.operators import keystats, sketches, sweep
from thinjoin.operators.exact import exact_join_agg, join_size
from thinjoin.operators.moments import moments
from thinjoin.operators.skew import join_by_key
from thinjoin.session import new_path, settle
from thinjoin.sources import catalog, text

# ---------------------------------------------------------------- sources


@query(
    "i01_text_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def text_scan(spark, folder):
    path = new_path(spark, "text")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    text.write_text(table(spark, folder, "orders").select(*columns), path, "|")
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
    return text.scan_text(spark, path, schema, "|")


def _lines_with_faults(spark, folder) -> str:
    """Orders as text; of some keys the status is missing, of others the price is a word, of others a field is too many."""
    path = new_path(spark, "text")
    key = F.col("o_orderkey")
    price = F.when(key % 11 == 0, "cheap").otherwise(F.col("o_custkey").cast("string"))
    status = F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    more = F.when(key % 13 == 0, "more")
    table(spark, folder, "orders").select(F.concat_ws("|", key, price, status, more)).write.text(path)
    return path


_FAULT = "o_orderkey % 11 = 0 OR (o_orderkey % 7 = 0) <> (o_orderkey % 13 = 0)"


@query(
    "i01_rows_that_fit",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'more' ELSE o_orderstatus END AS status FROM orders "
    f"WHERE NOT ({_FAULT})",
)
def rows_that_fit(spark, folder):
    checked = text.scan_checked(spark, _lines_with_faults(spark, folder), "o_orderkey BIGINT, o_custkey BIGINT, status STRING")
    return text.fitting_rows(checked)


@query(
    "i01_broken_lines",
    "SELECT concat_ws('|', o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'cheap' ELSE CAST(o_custkey AS VARCHAR) END, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 13 = 0 THEN 'more' END) AS line FROM orders "
    f"WHERE {_FAULT}",
)
def broken_lines(spark, folder):
    target, aside = new_path(spark, "fitting"), new_path(spark, "broken")
    text.checked_text_to_parquet(spark, _lines_with_faults(spark, folder), target, aside, "o_orderkey BIGINT, o_custkey BIGINT, status STRING")
    return spark.read.text(aside).withColumnRenamed("value", "line")


@query("i01_comma_text_scan", "SELECT p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size FROM part")
def comma_text_scan(spark, folder):
    path = new_path(spark, "text")
    text.write_text(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"), path, ",")
    return text.scan_text(spark, path, "p_partkey BIGINT, p_name STRING, p_size INT", ",")


@query(
    "i02_leading_columns",
    "SELECT l_orderkey AS col1, CAST(l_quantity AS INTEGER) AS col2, l_linenumber AS col3 FROM lineitem",
)
def leading_columns(spark, folder):
    path = new_path(spark, "text")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("int"), "l_linenumber", "l_returnflag"
    )
    text.write_text(rows, path)
    return text.scan_leading_columns(spark, path, ["BIGINT", "INT", "INT"])


@query(
    "i03_text_to_parquet",
    "SELECT l_orderkey AS col1, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey",
)
def text_to_parquet(spark, folder):
    source, target = new_path(spark, "text"), new_path(spark, "parquet")
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int"), "l_linenumber")
    text.write_text(rows, source)
    stored = text.text_to_parquet(spark, source, target, "col1 BIGINT, col2 INT, col3 INT")
    return stored.groupBy("col1").agg(F.count(F.lit(1)).alias("n"), F.sum("col2").alias("total"))


@query("i10_stored_key_stats", q.stats("lineitem", "l_orderkey", "l_quantity"))
def stored_key_stats(spark, folder):
    path = new_path(spark, "key-stats")
    for _ in range(2):  # the second call reads what the first one stored
        stats = catalog.stored_key_stats(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity", path)
    return stats


@query("i10_stored_for_two_measures", q.stats("lineitem", "l_orderkey", "l_linenumber"))
def stored_for_two_measures(spark, folder):
    """Statistics of another measure in the same folder are computed, not taken for stored."""
    path, lines = new_path(spark, "key-stats"), table(spark, folder, "lineitem")
    catalog.stored_key_stats(lines, "l_orderkey", "l_quantity", path)
    return catalog.stored_key_stats(lines, "l_orderkey", "l_linenumber", path)


@query("i11_stored_group_stats", q.stats(q.EVENTS, "user_id", "cents", ["event_type"]))
def stored_group_stats(spark, folder):
    path = new_path(spark, "group-stats")
    stats = catalog.stored_key_stats(events(spark, folder), "user_id", "cents", path, ["event_type"])
    return stats.select("event_type", "key", "a", "x", "s", "q")


# ---------------------------------------------------------------- predicates and scalar functions


@query(
    "p01_comparisons",
    " UNION ALL ".join(
        f"SELECT '{op}' AS op, count(*) AS n FROM lineitem WHERE l_quantity {op} 25" for op in ("=", "<", "<=", ">=", ">")
    ),
)
def comparisons(spark, folder):
    rows = table(spark, folder, "lineitem")
    ops = ("=", "<", "<=", ">=", ">")
    counted = rows.agg(*[F.count_if(predicates.compare("l_quantity", op, 25)).alias(f"n{i}") for i, op in enumerate(ops)])
    pairs = F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"n{i}").alias("n")) for i, op in enumerate(ops)])
    return counted.select(F.inline(pairs))


@query(
    "p02_not_equal",
    "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "WHERE l_linenumber <> 1 AND o_orderstatus <> 'P' GROUP BY l_returnflag",
)
def not_equal(spark, folder):
    left = table(spark, folder, "lineitem").where(predicates.compare("l_linenumber", "<>", 1))
    right = table(spark, folder, "orders").where(predicates.compare("o_orderstatus", "<>", "P"))
    found = exact_join_agg(left, right, "l_orderkey", "o_orderkey", "l_quantity", by="l_returnflag")
    return found.select("l_returnflag", F.col("count_actual").cast("long").alias("n"))


@query("p03_not_like", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '%SPEC%'")
def not_like(spark, folder):
    rows = table(spark, folder, "orders").where(predicates.lacks_text("o_orderpriority", "SPEC"))
    return rows.select("o_orderkey", "o_orderpriority")


@query("p04_in_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY event_type")
def in_list(spark, folder):
    rows = table(spark, folder, "events").where(predicates.one_of("event_type", ["view", "error"]))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p05_predicate_sweep",
    "SELECT v AS value, CAST((SELECT count(*) FROM lineitem WHERE l_quantity >= v) AS DOUBLE) AS at_least, "
    "CAST((SELECT count(*) FROM lineitem WHERE l_quantity = v) AS DOUBLE) AS equal "
    "FROM (SELECT unnest(range(CAST(min(l_quantity) AS BIGINT), CAST(max(l_quantity) AS BIGINT) + 1, 5)) AS v FROM lineitem)",
)
def predicate_sweep(spark, folder):
    rows = table(spark, folder, "lineitem")
    least = sweep.sweep_weights(rows, "l_quantity", 5, ">=").select("value", F.col("n_rows").alias("at_least"))
    equal = sweep.sweep_weights(rows, "l_quantity", 5, "=").select("value", F.col("n_rows").alias("equal"))
    return least.join(equal, "value")


@query(
    "p06_rate_clamp",
    "SELECT o_custkey, least(1.0::DOUBLE, greatest(0.1::DOUBLE, 1.0::DOUBLE/count(*))) AS rate, "
    "CASE WHEN 3.0::DOUBLE/count(*) > 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE/count(*) END AS kept FROM orders GROUP BY o_custkey",
    digits=("rate", "kept"),
)
def rate_clamp(spark, folder):
    n = F.count(F.lit(1)).cast("double")
    counted = table(spark, folder, "orders").groupBy("o_custkey").agg(n.alias("n"))
    wanted = 3 / F.col("n")
    return counted.select(
        "o_custkey",
        clamp_rate(1 / F.col("n"), 0.1, 0.05).alias("rate"),
        F.when(wanted > 1, 1.0).otherwise(wanted).alias("kept"),
    )


_KEY_DRAW = Draws(7, (1,), {"key": coefficients_needed(1)})
_ROW_DRAW = Draws(7, (1,), {"left": coefficients_needed(1)})


@query(
    "p07_key_hash",
    q.ctes(draws=q.draws(_KEY_DRAW))
    + f"SELECT key, {q.hashed(['key'], 'key')} AS pval FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem), draws",
)
def key_hash(spark, folder):
    keys = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    fanned, draw = _KEY_DRAW.attach(keys)
    return fanned.select("key", polynomial_hash(hash_parts(keys, ["key"]), lambda i: draw(f"key_{i}")).alias("pval"))


@query(
    "p08_key_hash_bucket",
    q.ctes(draws=q.draws(_KEY_DRAW))
    + f"SELECT key, CAST(floor({q.hashed(['key'], 'key')}/2147483647.0::DOUBLE*1000000) AS BIGINT) + 1 AS pval "
    "FROM (SELECT DISTINCT o_custkey AS key FROM orders), draws",
)
def key_hash_bucket(spark, folder):
    keys = table(spark, folder, "orders").select(F.col("o_custkey").alias("key")).distinct()
    fanned, draw = _KEY_DRAW.attach(keys)
    hashed = polynomial_hash(hash_parts(keys, ["key"]), lambda i: draw(f"key_{i}"))
    return fanned.select("key", (F.floor(unit_interval(hashed) * 1000000) + 1).alias("pval"))


@query(
    "p09_row_random",
    q.ctes(draws=q.draws(_ROW_DRAW)) + f"SELECT event_id, {q.hashed(['event_id'], 'left')}/2147483647.0::DOUBLE AS r FROM events, draws",
    digits=("r",),
)
def row_random(spark, folder):
    rows = table(spark, folder, "events").select("event_id")
    fanned, draw = _ROW_DRAW.attach(rows)
    hashed = polynomial_hash(hash_parts(rows, ["event_id"]), lambda i: draw(f"left_{i}"))
    return fanned.select("event_id", unit_interval(hashed).alias("r"))


@query(
    "p10_scalar_functions",
    "SELECT o_custkey, abs(sum(round(o_totalprice)) - 200000*count(*)) AS gap, sqrt(avg(o_totalprice)) AS root, "
    "max(o_totalprice)/min(o_totalprice) AS ratio FROM orders GROUP BY o_custkey",
    digits=("root", "ratio"),
)
def scalar_functions(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.abs(F.sum(F.round(price)) - 200000 * F.count(F.lit(1))).alias("gap"),
        F.sqrt(F.avg(price)).alias("root"),
        F.try_divide(F.max(price), F.min(price)).alias("ratio"),
    )


@query(
    "p11_calendar_predicate",
    "SELECT count(*) AS count_actual, sum(l_quantity) AS sum_actual, avg(l_quantity) AS avg_actual "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT'",
    digits=("avg_actual",),
)
def calendar_predicate(spark, folder):
    where = predicates.in_year("o_orderdate", 1997) & predicates.compare("o_orderpriority", "=", "1-URGENT")
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return in_longs(exact_join_agg(lines, orders, "l_orderkey", "o_orderkey", "l_quantity", right_where=where))


# ---------------------------------------------------------------- joins


@query(
    "j01_base_join",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def base_join(spark, folder):
    left = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    right = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return left.join(right, left["l_orderkey"] == right["o_orderkey"]).drop("o_orderkey")


@query(
    "j03_join_size",
    "SELECT count(*) AS n_join FROM events JOIN orders ON user_id = o_custkey",
)
def join_size_query(spark, folder):
    return in_longs(join_size(table(spark, folder, "events"), table(spark, folder, "orders"), "user_id", "o_custkey"))


@query(
    "j04_stats_join",
    q.ctes(ls=q.stats(q.EVENTS, "user_id", "cents"), rc=q.counts("orders", "o_custkey")) + "SELECT key, a, x, s, q, b FROM ls JOIN rc USING (key)",
)
def stats_join(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    return left.join(keystats.key_counts(table(spark, folder, "orders"), "o_custkey"), "key")


@query(
    "j05_group_parameter_join",
    "SELECT event_type, user_id, count(*) AS n, max(n_rows) AS n_rows FROM events JOIN "
    "(SELECT event_type AS grp, CAST(count(*) AS DOUBLE) AS n_rows FROM events GROUP BY event_type) ON event_type = grp "
    "GROUP BY event_type, user_id",
)
def group_parameter_join(spark, folder):
    rows = table(spark, folder, "events")
    profile = settle(keystats.group_profile(rows, "event_type", "user_id"), "profile")
    known = join_by_key(rows, "event_type", profile, "grp")
    return known.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_rows").alias("n_rows"))


@query(
    "j07_predicate_grid_stats",
    "SELECT v AS value, event_type, user_id, count(*) AS n FROM "
    "(SELECT unnest(range(CAST(floor(min(value)) AS BIGINT), CAST(floor(max(value)) AS BIGINT) + 1, 100)) AS v FROM events) "
    "JOIN events ON events.value >= v GROUP BY v, event_type, user_id",
)
def predicate_grid_stats(spark, folder):
    rows = table(spark, folder, "events").withColumn("_k", F.struct("event_type", "user_id"))
    stats = sweep.sweep_key_stats(rows, "_k", "value", "value", 100, ">=")
    return sweep.fill_down(stats, sweep.sweep_bounds(rows, "value"), 100).select(
        "value", "key.event_type", "key.user_id", F.col("a").cast("long").alias("n")
    )


# ---------------------------------------------------------------- statistics


@query("a01_key_counts", q.counts("events", "user_id"))
def key_counts(spark, folder):
    return keystats.key_counts(table(spark, folder, "events"), "user_id")


@query(
    "a02_key_mean_variance",
    "SELECT l_orderkey AS key, CAST(count(*) AS DOUBLE) AS a, avg(l_quantity) AS mean, "
    "coalesce(var_samp(l_quantity), 0.0) AS variance FROM lineitem GROUP BY l_orderkey",
    digits=("mean", "variance"),
)
def key_mean_variance(spark, folder):
    return keystats.key_mean_variance(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity")


@query(
    "a03_two_measures",
    "SELECT l_partkey AS key, CAST(count(*) AS DOUBLE) AS a, CAST(count(l_quantity) AS DOUBLE) AS x1, sum(l_quantity) AS s1, "
    "sum(l_quantity*l_quantity) AS q1, CAST(count(l_linenumber) AS DOUBLE) AS x2, CAST(sum(l_linenumber) AS DOUBLE) AS s2, "
    "CAST(sum(l_linenumber*l_linenumber) AS DOUBLE) AS q2 FROM lineitem GROUP BY l_partkey",
)
def two_measures(spark, folder):
    return keystats.key_stats_two(table(spark, folder, "lineitem"), "l_partkey", "l_quantity", "l_linenumber")


@query("a04_group_key_stats", q.stats("lineitem", "l_partkey", "l_quantity", ["l_returnflag"]))
def group_key_stats(spark, folder):
    return keystats.key_stats(table(spark, folder, "lineitem"), "l_partkey", "l_quantity", ["l_returnflag"])


@query(
    "a05_predicate_key_stats",
    "SELECT value, l_partkey AS key, CAST(count(*) AS DOUBLE) AS a, CAST(count(l_linenumber) AS DOUBLE) AS x, "
    "CAST(sum(l_linenumber) AS DOUBLE) AS s, CAST(sum(l_linenumber*l_linenumber) AS DOUBLE) AS q FROM "
    "(SELECT unnest(range(CAST(min(l_quantity) AS BIGINT), CAST(max(l_quantity) AS BIGINT) + 1, 10)) AS value FROM lineitem) "
    "JOIN lineitem ON l_quantity >= value GROUP BY value, l_partkey",
)
def predicate_key_stats(spark, folder):
    rows = table(spark, folder, "lineitem")
    stats = sweep.sweep_key_stats(rows, "l_partkey", "l_linenumber", "l_quantity", 10, ">=")
    return sweep.fill_down(stats, sweep.sweep_bounds(rows, "l_quantity"), 10)


@query(
    "a05_predicate_value_key_stats",
    "SELECT CAST(l_quantity AS BIGINT) AS value, l_partkey AS key, CAST(count(*) AS DOUBLE) AS a, CAST(count(l_linenumber) AS DOUBLE) AS x, "
    "CAST(sum(l_linenumber) AS DOUBLE) AS s, CAST(sum(l_linenumber*l_linenumber) AS DOUBLE) AS q FROM lineitem "
    "WHERE (l_quantity - (SELECT min(l_quantity) FROM lineitem)) % 5 = 0 GROUP BY 1, 2",
)
def predicate_value_key_stats(spark, folder):
    return sweep.sweep_key_stats(table(spark, folder, "lineitem"), "l_partkey", "l_linenumber", "l_quantity", 5, "=")


@query(
    "a06_heaviest_key",
    q.ctes(c=q.counts("events", "user_id", "a")) + "SELECT key, a AS rows FROM c ORDER BY a DESC, key LIMIT 1",
)
def heaviest_key(spark, folder):
    return keystats.heaviest_key(table(spark, folder, "events"), "user_id")


@query(
    "a07_group_profile",
    "SELECT l_returnflag AS grp, CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n_keys "
    "FROM lineitem GROUP BY l_returnflag",
)
def group_profile(spark, folder):
    return keystats.group_profile(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey")


MN = {"ls": q.stats(q.EVENTS, "user_id", "cents"), "rc": q.counts("orders", "o_custkey")}


@query("a08_moments", q.ctes(**MN) + q.moments(), digits=("s2b2",))
def moment_sums(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    return moments(left, keystats.key_counts(table(spark, folder, "orders"), "o_custkey"))


def in_longs(found):
    """Exact answers that fit 64 bits, in the type in which SQL counts."""
    return found.withColumns({f.name: F.col(f.name).cast("long") for f in found.schema if f.dataType.typeName() == "decimal"})


def whole_cents(spark, folder):
    """Events with the measure as a whole number, whose sums are decimals."""
    return events(spark, folder).withColumn("cents", F.col("cents").cast("long"))


_CENTS = q.EVENTS.replace("round(value * 100)", "CAST(round(value * 100) AS BIGINT)")


@query(
    "a09_exact_answers",
    "SELECT count(*) AS count_actual, CAST(sum(cents) AS BIGINT) AS sum_actual, avg(cents) AS avg_actual "
    f"FROM {_CENTS} JOIN orders ON user_id = o_custkey",
    digits=("avg_actual",),
)
def exact_answers(spark, folder):
    return in_longs(exact_join_agg(whole_cents(spark, folder), table(spark, folder, "orders"), "user_id", "o_custkey", "cents"))


@query(
    "a09_exact_self_join",
    "SELECT count(*) AS count_actual, sum(l.l_quantity) AS sum_actual, avg(l.l_quantity) AS avg_actual "
    "FROM lineitem l JOIN lineitem r ON l.l_partkey = r.l_partkey",
    digits=("avg_actual",),
)
def exact_self_join(spark, folder):
    rows = table(spark, folder, "lineitem")
    return in_longs(exact_join_agg(rows, rows, "l_partkey", "l_partkey", "l_quantity"))


@query(
    "a10_exact_filtered",
    "SELECT value, count(o_custkey) AS count_actual, CAST(coalesce(sum(cents), 0) AS BIGINT) AS sum_actual, coalesce(avg(cents), 0) AS avg_actual FROM "
    "(SELECT unnest(range(min(cents), max(cents) + 1, 1000)) AS value "
    f"FROM {_CENTS}) LEFT JOIN (SELECT * FROM {_CENTS} JOIN orders ON user_id = o_custkey) ON cents >= value GROUP BY value",
    digits=("avg_actual",),
)
def exact_filtered(spark, folder):
    return in_longs(
        sweep.sweep_answers(
            whole_cents(spark, folder), table(spark, folder, "orders"), "user_id", "o_custkey", "cents", "cents", 1000, ">="
        )
    )


@query(
    "a11_exact_grouped",
    "SELECT event_type, count(*) AS count_actual, CAST(sum(cents) AS BIGINT) AS sum_actual, avg(cents) AS avg_actual "
    f"FROM {_CENTS} JOIN orders ON user_id = o_custkey GROUP BY event_type",
    digits=("avg_actual",),
)
def exact_grouped(spark, folder):
    return in_longs(
        exact_join_agg(
            whole_cents(spark, folder), table(spark, folder, "orders"), "user_id", "o_custkey", "cents", by="event_type"
        )
    )


@query(
    "a12_column_profile",
    "SELECT min(l_quantity) AS min_value, max(l_quantity) AS max_value, max(l_orderkey) AS max_key, count(*) AS n_rows, "
    "count(DISTINCT l_returnflag) AS n_groups FROM lineitem",
)
def column_profile(spark, folder):
    return keystats.column_profile(table(spark, folder, "lineitem"), "l_quantity", "l_orderkey", "l_returnflag")


@query(
    "a13_value_weights",
    "SELECT l_quantity AS value, count(*) AS n_rows, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM lineitem) AS weight "
    "FROM lineitem GROUP BY l_quantity",
    digits=("weight",),
)
def value_weights(spark, folder):
    return keystats.value_weights(table(spark, folder, "lineitem"), "l_quantity")


@query("a14_key_means", "SELECT l_orderkey AS key, avg(l_quantity) AS mean FROM lineitem GROUP BY l_orderkey", digits=("mean",))
def key_means(spark, folder):
    return keystats.key_means(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity")


SKETCHES = 20
_SIGNS = Draws(3, tuple(range(1, SKETCHES + 1)), {"sign": coefficients_needed(1)})
_SIGN = f"(({q.hashed(['key'], 'sign')}) % 2 * 2 - 1)"


def sketch_ctes() -> dict[str, str]:
    left = {"a": "a", "a2": "a*a", "x": "x", "x2": "x*x", "s": "s", "s2": "s*s", "q": "q", "xs": "x*s"}
    right = {"b": "b", "b2": "b*b"}
    lsums = ", ".join(f"sum({e}*{_SIGN}) AS u_{n}" for n, e in left.items())
    rsums = ", ".join(f"sum({e}*{_SIGN}) AS v_{n}" for n, e in right.items())
    products = ", ".join(f"avg(u_{n[:n.index('b')]}*v_{n[n.index('b'):]}) AS {n}" for n in q.MOMENTS)
    return {
        **MN,
        "draws": q.draws(_SIGNS),
        "lk": f"SELECT replicate, {lsums} FROM ls, draws GROUP BY replicate",
        "rk": f"SELECT replicate, {rsums} FROM rc, draws GROUP BY replicate",
        "m": f"SELECT {products} FROM lk JOIN rk USING (replicate)",
    }


@query("a15_sketched_join_size", q.ctes(**sketch_ctes()) + "SELECT ab AS n_join FROM m", digits=("n_join",))
def sketched_join_size(spark, folder):
    left = keystats.key_counts(table(spark, folder, "events"), "user_id", "a")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    return sketches.sketched_join_size(left, right, SKETCHES, seed=3)


@query("a16_sketched_moments", q.ctes(**sketch_ctes()) + "SELECT * FROM m", digits=tuple(q.MOMENTS))
def sketched_moments(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    return sketches.sketched_moments(left, right, SKETCHES, seed=3)


_ROW_SIGNS = Draws(4, tuple(range(1, sketches.ROWS + 1)), {"sign": coefficients_needed(1)})


def bucketed_ctes(width: int) -> dict[str, str]:
    """Bucket and sign from the same hash, sums per bucket, products per hash row, their median."""
    left = {"a": "a", "a2": "a*a", "x": "x", "x2": "x*x", "s": "s", "s2": "s*s", "q": "q", "xs": "x*s"}
    right = {"b": "b", "b2": "b*b"}
    hashed = f"SELECT *, {q.hashed(['key'], 'sign')} AS h FROM {{0}}, draws"
    sums = lambda of, side: ", ".join(f"sum({e}*(h % 2 * 2 - 1)) AS {side}_{n}" for n, e in of.items())
    products = ", ".join(f"coalesce(sum(u_{n[:n.index('b')]}*v_{n[n.index('b'):]}), 0.0) AS {n}" for n in q.MOMENTS)
    return {
        **MN,
        "draws": q.draws(_ROW_SIGNS),
        "lb": f"SELECT replicate, (h >> 1) % {width} AS bucket, {sums(left, 'u')} FROM ({hashed.format('ls')}) GROUP BY ALL",
        "rb": f"SELECT replicate, (h >> 1) % {width} AS bucket, {sums(right, 'v')} FROM ({hashed.format('rc')}) GROUP BY ALL",
        "pr": f"SELECT d.replicate, {products} FROM draws d LEFT JOIN (lb JOIN rb USING (replicate, bucket)) b ON b.replicate = d.replicate GROUP BY ALL",
        "m": "SELECT " + ", ".join(f"median({n}) AS {n}" for n in q.MOMENTS) + " FROM pr",
    }


@query("a15_bucketed_join_size", q.ctes(**bucketed_ctes(sketches.WIDTH)) + "SELECT ab AS n_join FROM m", digits=("n_join",))
def bucketed_join_size(spark, folder):
    """A thousand counters, five additions per key."""
    left = keystats.key_counts(table(spark, folder, "events"), "user_id", "a")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    return sketches.bucketed_join_size(left, right, seed=4)


@query("a16_bucketed_moments", q.ctes(**bucketed_ctes(sketches.WIDTH)) + "SELECT * FROM m", digits=tuple(q.MOMENTS))
def bucketed_moments(spark, folder):
    left = keystats.key_stats(events(spark, folder), "user_id", "cents")
    right = keystats.key_counts(table(spark, folder, "orders"), "o_custkey")
    return sketches.bucketed_moments(left, right, seed=4)


@query(
    "l03_largest_group",
    "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ORDER BY n DESC, o_custkey LIMIT 1",
)
def largest_group(spark, folder):
    top = keystats.heaviest_key(table(spark, folder, "orders"), "o_custkey")
    return top.select(F.col("key").alias("o_custkey"), F.col("rows").cast("long").alias("n"))
