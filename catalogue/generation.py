"""Synthetic tables, generated from the row numbers of a given table so that their size follows it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalogue import sql as q
from catalogue.registry import query, table
from thinjoin.functions import variates as v
from thinjoin.functions.hashing import PRIME, draw_coefficients
from thinjoin.session import new_path
from thinjoin.sources import synthetic

ROW, SEED = "o_orderkey", 17
KEYS = "(SELECT count(*) FROM customer)"


def _lane(seed: int, role: str, row: str) -> str:
    c = draw_coefficients(seed, role, 0, 5)
    low, high = f"({row} & {PRIME})", f"(({row} >> 31) & {PRIME})"
    value = f"{c[3]}::BIGINT"
    for i in (2, 1, 0):
        value = f"(({value}*{low} + {c[i]}::BIGINT) % {PRIME})"
    return f"(({value} + {c[4]}::BIGINT*{high}) % {PRIME})"


def u(role: str, row: str = ROW, seed: int = SEED) -> str:
    p = f"{float(PRIME)!r}::DOUBLE"
    return f"(({_lane(seed, role + '.high', row)} + {_lane(seed, role + '.low', row)}/{p})/{p})"


def coarse(role: str, row: str, seed: int) -> str:
    return f"({_lane(seed, role, row)}/{float(PRIME)!r}::DOUBLE)"


def normal(role: str, row: str = ROW, seed: int = SEED) -> str:
    return f"(sqrt(-2*ln(1 - {coarse(role + '.radius', row, seed)}))*cos({2 * math.pi!r}::DOUBLE*{coarse(role + '.angle', row, seed)}))"


def truncated(role: str, mean: str, sd: str, low: str, high: str, row: str = ROW, seed: int = SEED) -> str:
    draws = [f"({mean} + {sd}*{normal(f'{role}.{i}', row, seed)})" for i in range(v.TRIES)]
    tries = ", ".join(f"CASE WHEN {d} BETWEEN {low} AND {high} THEN {d} END" for d in draws)
    return f"coalesce({tries}, least({high}, greatest({low}, {draws[-1]})))"


def power(role: str, alpha: float, high: str, row: str = ROW, seed: int = SEED) -> str:
    k = alpha + 1
    return f"least(CAST(floor(pow({u(role, row, seed)}*(pow({high}::DOUBLE, {k!r}::DOUBLE) - 1) + 1, {1 / k!r}::DOUBLE)) AS BIGINT), {high})"


def relabelled(value: str, n: str, seed: int = SEED) -> str:
    number, shift = v.relabel_numbers(seed)
    return f"((({value}) - 1)*{number}::BIGINT + {shift}) % {n} + 1"


def key_sql(distribution: str, row: str = ROW, seed: int = SEED) -> str:
    if distribution == "uniform":
        drawn = f"CAST(floor({u('key', row, seed)}*{KEYS}) AS BIGINT) + 1"
    elif distribution in v.NORMAL_SPREADS:
        sd = f"({KEYS}/{v.NORMAL_SPREADS[distribution]}.0::DOUBLE)"
        value = truncated("key", f"({KEYS}/2.0::DOUBLE)", sd, "1.0::DOUBLE", f"{KEYS}::DOUBLE", row, seed)
        drawn = f"CAST(round({value}) AS BIGINT)"
    else:
        drawn = power("key", v.POWER_LAWS[distribution], KEYS, row, seed)
    return relabelled(drawn, KEYS, seed)


MEASURE = f"{relabelled(power('measure', -1.5, '1000'), '1000')}"
SECOND = f"CAST(floor({u('second')}*99) AS BIGINT) + 1"


def _keys(spark, folder):
    return table(spark, folder, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()


def _rows(spark, folder):
    return table(spark, folder, "orders").select(ROW)


_IDS = {"uniform": "g01", **dict.fromkeys(v.NORMAL_SPREADS, "g02"), **dict.fromkeys(v.POWER_LAWS, "g03")}

for _distribution, _id in _IDS.items():

    @query(
        f"{_id}_{_distribution}_keys",
        f"SELECT {ROW}, {key_sql(_distribution)} AS col1, {MEASURE} AS col2, {SECOND} AS col3 FROM orders",
    )
    def keyed(spark, folder, distribution=_distribution):
        return synthetic.synthetic_table(_rows(spark, folder), _keys(spark, folder), distribution, SEED, ROW)


@query(
    "g04_relabelled_keys",
    f"SELECT c_custkey, {relabelled('c_custkey + 1', KEYS)} AS label FROM customer",
)
def relabelled_keys(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.select("c_custkey", v.relabel(F.col("c_custkey") + 1, _keys(spark, folder), SEED).alias("label"))


@query(
    "g05_measures",
    f"SELECT {ROW}, {MEASURE} AS power_measure, round(100 + 25*{normal('measure')}, 1) AS normal_measure, {SECOND} AS second FROM orders",
)
def measures(spark, folder):
    row = F.col(ROW)
    power_law, normal_law = (synthetic.measure_columns(row, SEED, m) for m in ("powerlaw", "normal"))
    return _rows(spark, folder).select(
        ROW,
        power_law["col2"].alias("power_measure"),
        normal_law["col2"].alias("normal_measure"),
        power_law["col3"].alias("second"),
    )


@query(
    "p12_rounding_functions",
    f"SELECT {ROW}, CAST(floor(o_totalprice) AS BIGINT) AS whole, round(pow(o_totalprice, 0.5::DOUBLE)) AS root, o_custkey % 7 AS residue FROM orders",
)
def rounding_functions(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        ROW,
        F.floor(price).alias("whole"),
        F.round(F.pow(price, F.lit(0.5))).alias("root"),
        F.pmod("o_custkey", F.lit(7)).alias("residue"),
    )


@query(
    "g06_worst_case_table",
    q.ctes(
        c=q.counts("events", "user_id", "a"),
        h="SELECT key FROM c ORDER BY a DESC, key LIMIT 1",
    )
    + f"SELECT {ROW}, CASE WHEN {u('worst')} < 0.75 THEN (SELECT key FROM h) ELSE CAST(floor({u('key')}*{KEYS}) AS BIGINT) + 1 END AS col1, "
    f"{MEASURE} AS col2, {SECOND} AS col3 FROM orders",
)
def worst_case_table(spark, folder):
    left = table(spark, folder, "events")
    return synthetic.worst_case_table(_rows(spark, folder), left, "user_id", _keys(spark, folder), SEED, ROW)


_NOISE = f"CAST(trunc({normal('noise')}*100) AS BIGINT)"
_WIDTH = f"({KEYS}/100.0::DOUBLE)"
_UNIFORM_KEY = key_sql("uniform")
RELATIONS = {
    "uniform": f"CAST(floor({u('predicate')}*100) AS BIGINT)",
    "normal": f"CAST(round({truncated('predicate', '50.0::DOUBLE', '10.0::DOUBLE', '0.0::DOUBLE', '100.0::DOUBLE')}) AS BIGINT)",
    "powerlaw": f"{power('predicate', -1.5, '101')} - 1",
    "powerlaw2": f"{power('predicate', -2.5, '101')} - 1",
    "positive": f"CAST(floor((({_UNIFORM_KEY}) + {_NOISE})/{_WIDTH}) AS BIGINT)",
    "negative": f"CAST(floor(({KEYS} + 1 - ({_UNIFORM_KEY}) + {_NOISE})/{_WIDTH}) AS BIGINT)",
}

for _relation, _value in RELATIONS.items():

    @query(
        f"g07_predicate_column_{_relation}",
        f"SELECT {ROW}, {_UNIFORM_KEY} AS col1, least(greatest({_value}, 0), 99) AS col3 FROM orders",
    )
    def predicate_column(spark, folder, relation=_relation):
        made = synthetic.synthetic_table(
            _rows(spark, folder), _keys(spark, folder), "uniform", SEED, ROW, relation=relation, predicate_values=100
        )
        return made.select(ROW, "col1", "col3")


@query(
    "g08_payload",
    f"SELECT {ROW}, substring(repeat(upper(md5(CAST({ROW} AS VARCHAR))), 7), 1, 200) AS col4 FROM orders",
)
def payload(spark, folder):
    made = synthetic.synthetic_table(_rows(spark, folder), _keys(spark, folder), "uniform", SEED, ROW, with_payload=True)
    return made.select(ROW, "col4")


_GRID = [(d, side) for d in ("uniform", "normal", "powerlaw") for side in (1, 2)]


@query(
    "g09_stored_grid",
    " UNION ALL ".join(
        f"SELECT '{d}_{side}' AS table_name, count(*) AS n_rows, max(k) AS max_key, count(DISTINCT k) AS n_keys "
        f"FROM (SELECT {key_sql(d, 'i', side)} AS k FROM (SELECT i::BIGINT AS i FROM range((SELECT count(*) FROM orders)) t(i)))"
        for d, side in _GRID
    ),
)
def stored_grid(spark, folder):
    """Both sides of three distributions with as many rows as there are orders; rows and keys of each stored table."""
    rows = table(spark, folder, "orders").count()
    keys = table(spark, folder, "customer").count()
    path = new_path(spark, "grid")
    parts = []
    for stored in synthetic.write_grid(spark, path, rows, keys, ("uniform", "normal", "powerlaw")):
        name = stored.rsplit("/", 1)[1]
        counted = spark.read.parquet(stored).agg(
            F.count(F.lit(1)).alias("n_rows"), F.max("col1").alias("max_key"), F.countDistinct("col1").alias("n_keys")
        )
        parts.append(counted.select(F.lit(name).alias("table_name"), "*"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
