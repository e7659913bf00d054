"""Parquet tables: those that may not be there, and a physical row identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or ``None``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def not_in(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``old``; NULL keys compare as equal."""
    known = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    same = [new[k].eqNullSafe(known[f"_old_{k}"]) for k in keys]
    return new.join(known, same, "left_anti")


def with_row_id(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """The Parquet table at ``path`` plus a 64-bit identity of each physical row.

    File and position in the file do not change with splits, retries or cluster size, so samples drawn by this
    identity repeat exactly, and equal rows are still drawn independently.
    """
    table = spark.read.parquet(path)
    identity = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return table.select("*", identity.alias(name))
