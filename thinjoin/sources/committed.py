"""Tables that grow by whole batches.

A batch is written to a folder of its own. Then one row for each *unit* that it holds, naming the folder, is appended to
the commits. A unit is what may stand in the table once: a replicate of a configuration, a group of a sample. Only what
the commits name is read. A batch that died half-way is not named, and of a unit that was committed twice, by two runs
at once or by a run that was taken for dead, the first commit counts. So adding units again, after any failure, changes
nothing, and units without rows (a group that no sample met) are known to be done.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.session import settle
from thinjoin.sources.tables import existing, not_in


@dataclass(frozen=True)
class CommittedTable:
    """A table in ``folder`` of which every combination of the columns ``unit`` is added once."""

    folder: str
    unit: tuple[str, ...]

    def commits(self, spark: SparkSession) -> DataFrame | None:
        """(unit, _batch): the batch that counts for each unit, or ``None`` if there is none yet."""
        rows = existing(spark, f"{self.folder}/commits")
        if rows is None:
            return None
        first = F.min_by("_batch", F.struct("_ts", "_batch")).alias("_batch")
        return rows.groupBy(*self.unit).agg(first)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The units among ``wanted`` that are not there yet; NULL is a value like others."""
        units = wanted.select(*self.unit).distinct()
        held = self.commits(wanted.sparkSession)
        return units if held is None else not_in(units, held, self.unit)

    def add(self, rows: DataFrame, wanted: DataFrame) -> None:
        """Append the rows of those units of ``wanted`` that are not there yet, as one batch."""
        units = settle(self.missing(wanted), "units")
        if not units.isEmpty():
            self._write(self._of_units(rows, units, self.unit), units)

    def _write(self, rows: DataFrame, units: DataFrame) -> None:
        batch = f"b-{uuid.uuid4().hex}"
        self._write_rows(rows, batch)
        self._commit(units, batch)

    def _write_rows(self, rows: DataFrame, batch: str) -> None:
        rows.write.parquet(f"{self.folder}/rows/_batch={batch}")

    def _commit(self, units: DataFrame, batch: str) -> None:
        named = units.withColumns({"_batch": F.lit(batch), "_ts": F.current_timestamp()})
        named.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    @staticmethod
    def _of_units(rows: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
        known = units.select(*[F.col(k).alias(f"_unit_{k}") for k in keys])
        return rows.join(known, [rows[k].eqNullSafe(known[f"_unit_{k}"]) for k in keys], "left_semi")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows of committed units, each from the batch that counts; ``None`` if nothing was ever added."""
        held = self.commits(spark)
        if held is None:
            return None
        names = sorted(r["_batch"] for r in held.select("_batch").distinct().collect())
        paths = [f"{self.folder}/rows/_batch={name}" for name in names]
        rows = spark.read.option("basePath", f"{self.folder}/rows").parquet(*paths)
        return self._of_units(rows, held, [*self.unit, "_batch"]).drop("_batch")

    def drop_unread(self, spark: SparkSession) -> list[str]:
        """Delete the batches that count for no unit; not while others are adding. Returns their names."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = self.commits(spark)
        names = set() if held is None else {r["_batch"] for r in held.select("_batch").distinct().collect()}
        there = files.listStatus(root) if files.exists(root) else []
        unread = [entry.getPath() for entry in there if entry.getPath().getName().removeprefix("_batch=") not in names]
        for path in unread:
            files.delete(path, True)
        return [path.getName().removeprefix("_batch=") for path in unread]
