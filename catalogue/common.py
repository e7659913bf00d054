"""The table pairs the queries run on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogue import sql as q
from catalogue.registry import events, table
from thinjoin.functions.hashing import Draws, coefficients_needed
from thinjoin.functions.rates import Rates
from thinjoin.operators.keystats import key_counts, key_stats
from thinjoin.operators.moments import moments
from thinjoin.operators.sampling import RateSource, Side, make_draws

LINE_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def event_side(spark: SparkSession, folder: str) -> Side:
    return Side(events(spark, folder), "user_id", ("event_id",))


def order_side(spark: SparkSession, folder: str, key: str = "o_custkey") -> Side:
    return Side(table(spark, folder, "orders"), key, ("o_orderkey",))


def line_side(spark: SparkSession, folder: str, key: str = "l_orderkey") -> Side:
    return Side(table(spark, folder, "lineitem"), key, LINE_ID)


def event_order_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Events with orders on the customer: many-to-many."""
    return moments(
        key_stats(events(spark, folder), "user_id", "cents"), key_counts(table(spark, folder, "orders"), "o_custkey")
    )


def line_order_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with orders: one-to-many."""
    return moments(
        key_stats(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity"),
        key_counts(table(spark, folder, "orders"), "o_orderkey"),
    )


def part_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with themselves on the part: heavy many-to-many."""
    rows = table(spark, folder, "lineitem")
    return moments(key_stats(rows, "l_partkey", "l_quantity"), key_counts(rows, "l_partkey"))


def pair_draws(rates: RateSource, replicates, seed: int, left_id: int = 1, right_id: int = 1) -> Draws:
    """The draws ``sample_pair`` uses, for the SQL side."""
    roles = {
        "key": coefficients_needed(1),
        "left": coefficients_needed(left_id),
        "right": coefficients_needed(right_id),
    }
    return make_draws(rates, replicates, seed, roles)


ANY = Rates(1.0, 1.0, 1.0)
EVENT_ORDER = {
    "ls": q.stats(q.EVENTS, "user_id", "cents"),
    "rc": q.counts("orders", "o_custkey"),
    "m": q.moments(),
}
LINE_ORDER = {
    "ls": q.stats("lineitem", "l_orderkey", "l_quantity"),
    "rc": q.counts("orders", "o_orderkey"),
    "m": q.moments(),
}
PART = {
    "ls": q.stats("lineitem", "l_partkey", "l_quantity"),
    "rc": q.counts("lineitem", "l_partkey"),
    "m": q.moments(),
}
EVENT_ORDER_ACTUAL = (
    "SELECT CAST(count(*) AS DOUBLE) AS count_actual, sum(cents) AS sum_actual, avg(cents) AS avg_actual "
    f"FROM {q.EVENTS} JOIN orders ON user_id = o_custkey"
)


def event_order_samples(rates: str, draws: Draws) -> dict[str, str]:
    """CTEs for the events/orders sample pair; ``rates`` is a one-row CTE body or empty when draws hold the rates."""
    parts = {"draws": q.draws(draws)}
    if rates:
        parts["r"] = rates
        p, q1, q2 = "(SELECT p FROM r)", "(SELECT q1 FROM r)", "(SELECT q2 FROM r)"
    else:
        p, q1, q2 = "p", "q1", "q2"
    parts["s1"] = q.sample(q.EVENTS, "user_id", ["event_id"], "left", p, q1, "event_id, user_id, event_type, cents")
    parts["s2"] = q.sample("orders", "o_custkey", ["o_orderkey"], "right", p, q2, "o_orderkey, o_custkey, o_orderstatus")
    parts["t"] = q.totals("s1", "s2", "user_id", "o_custkey", "cents")
    return parts


def literal_rates(r: Rates) -> str:
    return f"SELECT {r.p!r}::DOUBLE AS p, {r.q1!r}::DOUBLE AS q1, {r.q2!r}::DOUBLE AS q2"
