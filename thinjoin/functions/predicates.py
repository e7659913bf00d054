"""Filter predicates as Columns."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "=": operator.eq,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "<>": operator.ne,
}


def compare(column: str, op: str, value) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unsupported comparison: {op}")
    return COMPARISONS[op](F.col(column), F.lit(value))


def lacks_text(column: str, text: str) -> Column:
    """``NOT LIKE '%text%'``."""
    return ~F.col(column).contains(text)


def one_of(column: str, values: Sequence) -> Column:
    return F.col(column).isin(list(values))


def in_year(column: str, year: int) -> Column:
    """Rows of one calendar year, as a range so that it reaches the Parquet scan."""
    start, end = (F.to_timestamp(F.lit(f"{y}-01-01")) for y in (year, year + 1))
    return (F.col(column) >= start) & (F.col(column) < end)
