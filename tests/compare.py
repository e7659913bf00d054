"""Compare registered queries with their SQL on DuckDB: names, row counts and values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from glob import glob

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "/root/testdata"


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """A description of the first difference, or ``None``."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0][0]} != {bad[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from thinjoin.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else f"{TABLES}/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = queries[name](spark, folder)
            if name in oracles:
                problem = difference(found, connection, oracles[name])
                note = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                note = f"no SQL, {found.count()} rows"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += note.startswith(("ERROR", "DIFF"))
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
