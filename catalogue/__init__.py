"""The registered queries over the given tables, and the SQL each is checked against."""

from catalogue import estimation, generation, planning, reporting, runs, sampling, statistics  # noqa: F401
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
