"""Stored samples, sample metadata and key statistics.

Every batch of replicates is written to a folder of its own, and its metadata rows, which name that folder, are appended
after it. Only what metadata names counts as stored: a batch that died half-way is drawn again, and nothing is ever
replaced in place. A sample is known by its names, preset, replicate, rates and seed; samples are opened by their
metadata, so the rates that scale an estimate are the rates the rows were drawn with.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.functions.hashing import DRAW_KEY
from thinjoin.functions.rates import Rates
from thinjoin.operators.keystats import key_counts, key_stats
from thinjoin.operators.sampling import (
    RateSource,
    SamplePair,
    Side,
    fixed_rates,
    pair_draws,
    rate_columns,
    sample_pair,
)
from thinjoin.operators.stratified import GroupedSample
from thinjoin.sources.committed import CommittedTable
from thinjoin.sources.tables import existing

REPLICATES_PER_JOB = 100
META_IDENTITY = ("t1_name", "t2_name", "agg", "t1_join_col", "t2_join_col", "t1_agg_col")
RATE_COLUMNS = ("p", "q1", "q2")
SAMPLE_KEY = (*META_IDENTITY, *DRAW_KEY, *RATE_COLUMNS, "seed")


def write_sample(df: DataFrame, path: str) -> None:
    """Write a sample to a new path, partitioned by draw.

    The rebalance gathers a replicate's rows into files of the advisory size and splits large ones, so a sample does
    not end in one small file per task.
    """
    df.hint("rebalance", *[F.col(c) for c in DRAW_KEY]).write.partitionBy(*DRAW_KEY).parquet(path)


def stored_samples(spark: SparkSession, folder: str, identity: Mapping[str, str] | None = None) -> DataFrame | None:
    """The newest metadata row of every stored sample, or ``None`` if there is none."""
    meta = existing(spark, f"{folder}/meta")
    if meta is None:
        return None
    for name, value in (identity or {}).items():
        meta = meta.where(F.col(name).eqNullSafe(F.lit(value)))
    newest = meta.groupBy(*SAMPLE_KEY).agg(F.max_by(F.struct("path", "ts"), F.struct("ts", "path")).alias("_row"))
    return newest.select(*SAMPLE_KEY, "_row.*")


def _presets(rates: RateSource) -> list[Rates]:
    return [rates] if isinstance(rates, Rates) else list(rates)


def _drawn_with(preset: int, rates: Rates, seed: int) -> Column:
    same = [F.col(n) == F.lit(float(getattr(rates, n))) for n in RATE_COLUMNS]
    return (F.col("preset") == preset) & (F.col("seed") == seed) & same[0] & same[1] & same[2]


def missing_replicates(
    spark: SparkSession, folder: str, replicates: int, identity: Mapping[str, str], rates: RateSource, seed: int = 1
) -> list[int]:
    """Requested replicates that are not stored for these names, rates and seed in every preset."""
    wanted = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    meta = stored_samples(spark, folder, identity)
    if meta is not None:
        presets = _presets(rates)
        matches = F.lit(False)
        for number, one in enumerate(presets):
            matches = matches | _drawn_with(number, one, seed)
        complete = meta.where(matches).groupBy("replicate").count().where(F.col("count") == len(presets))
        wanted = wanted.join(complete, "replicate", "left_anti")
    return [row["replicate"] for row in wanted.orderBy("replicate").collect()]


def store_pair(
    left: Side,
    right: Side,
    rates: RateSource | DataFrame,
    folder: str,
    replicates: int,
    identity: Mapping[str, str],
    seed: int = 1,
    overwrite: bool = False,
) -> DataFrame:
    """Draw the replicates that are not stored yet (all with ``overwrite``); return the newest metadata.

    Replicates are drawn ``REPLICATES_PER_JOB`` to a scan, and each such batch is complete once its metadata is there.
    """
    spark = left.table.sparkSession
    rates = fixed_rates(rates)
    every = list(range(1, replicates + 1))
    needed = every if overwrite else missing_replicates(spark, folder, replicates, identity, rates, seed)
    for start in range(0, len(needed), REPLICATES_PER_JOB):
        pair = sample_pair(left, right, rates, needed[start : start + REPLICATES_PER_JOB], seed)
        batch = f"{folder}/batch-{uuid.uuid4().hex}"
        write_sample(pair.left, f"{batch}/left")
        write_sample(pair.right, f"{batch}/right")
        record_sample(pair, f"{folder}/meta", identity, seed, batch)
    return stored_samples(spark, folder)


def record_sample(pair: SamplePair, path: str, identity: Mapping[str, str], seed: int = 1, batch: str | None = None) -> None:
    """Append one metadata row per draw: names, rates, seed, where the rows are, time."""
    rates = rate_columns(pair.rates) or {name: F.col(name) for name in RATE_COLUMNS}
    rows = pair.draw_table().select(
        *[F.lit(identity[name]).alias(name) for name in META_IDENTITY],
        *DRAW_KEY,
        *[c.cast("double").alias(n) for n, c in rates.items()],
        F.lit(seed).cast("long").alias("seed"),
        F.lit(batch).cast("string").alias("path"),
        F.current_timestamp().alias("ts"),
    )
    rows.coalesce(1).write.mode("append").parquet(path)


def latest_samples(meta: DataFrame, identity: Sequence[str] = META_IDENTITY) -> DataFrame:
    """The newest metadata per identity."""
    rest = [c for c in meta.columns if c not in (*identity, "ts")]
    newest = meta.groupBy(*identity).agg(F.max("ts").alias("ts"), F.max_by(F.struct(*rest), "ts").alias("_row"))
    return newest.select(*identity, "ts", "_row.*")


def load_pair(
    left: Side,
    right: Side,
    folder: str,
    replicates: int | Sequence[int],
    identity: Mapping[str, str],
    rates: RateSource | DataFrame | None = None,
    seed: int | None = None,
) -> SamplePair:
    """A stored pair, opened by its metadata.

    The rates and the seed are those of the newest sample of these names, unless given; asking for rates, a seed or
    replicates that are not stored is an error. Only the batches that metadata names are read, and the partition
    columns prune the files of other draws.
    """
    spark = left.table.sparkSession
    meta = stored_samples(spark, folder, identity)
    newest = None if meta is None else meta.orderBy(F.desc("ts"), F.desc("replicate")).first()
    if newest is None:
        raise ValueError("no stored sample of these names")
    seed = newest["seed"] if seed is None else seed
    if rates is None:
        batch = meta.where(F.col("path") == newest["path"]).groupBy("preset").agg(*[F.max(n).alias(n) for n in RATE_COLUMNS])
        found = [Rates(*[r[n] for n in RATE_COLUMNS]) for r in batch.orderBy("preset").collect()]
        rates = found[0] if len(found) == 1 else found
    rates = fixed_rates(rates)
    wanted = list(range(1, replicates + 1)) if isinstance(replicates, int) else list(replicates)
    absent = sorted(set(missing_replicates(spark, folder, max(wanted), identity, rates, seed)) & set(wanted))
    if absent:
        raise ValueError(f"not stored with these rates and this seed: replicates {absent[:10]}")
    matches = F.lit(False)
    for number, one in enumerate(_presets(rates)):
        matches = matches | _drawn_with(number, one, seed)
    draws = meta.where(matches & F.col("replicate").isin(wanted)).select("path", *DRAW_KEY).collect()
    sides = []
    for name, table in (("left", left.table), ("right", right.table)):
        parts = []
        for path in sorted({d["path"] for d in draws}):
            schema = table.select(F.lit(0).alias("preset"), F.lit(0).alias("replicate"), "*").schema
            rows = spark.read.schema(schema).parquet(f"{path}/{name}")
            held = F.lit(False)
            for preset in sorted({d["preset"] for d in draws}):
                of = [d["replicate"] for d in draws if d["path"] == path and d["preset"] == preset]
                held = held | ((F.col("preset") == preset) & F.col("replicate").isin(of))
            parts.append(rows.where(held).select(*DRAW_KEY, *table.columns))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        sides.append(whole)
    return SamplePair(*sides, left.key, right.key, rates, pair_draws(left, right, rates, wanted, seed))


def group_sample_table(path: str, group: str) -> CommittedTable:
    """Left rows of group samples under ``path``; a group of a draw is there once."""
    return CommittedTable(path, (*DRAW_KEY, group))


def append_group_sample(sample: GroupedSample, path: str) -> None:
    """Append the left rows of all groups, with the key's hash value ``pval``, in one job.

    Groups of a draw that are there already are left as they are, so an append that failed can be repeated.
    """
    units = sample.parameters.select(F.col("grp").alias(sample.group), F.inline(sample.draws.identities()).alias(*DRAW_KEY))
    group_sample_table(path, sample.group).add(sample.left, units)


def stored_key_stats(df: DataFrame, key: str, measure: str | None, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Key statistics kept under ``path``: computed on first use, read afterwards.

    What is stored is described by the files and the plan of ``df``, the key, the measure and ``by``; other statistics
    lie beside it. The description is appended after the data, so a run that died is repeated. With ``by``, all groups
    are computed in one job and stored partitioned by group.
    """
    spark = df.sparkSession
    parts = [sorted(df.inputFiles()), df.semanticHash(), key, measure, list(by)]
    description = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
    known = existing(spark, f"{path}/contents")
    row = None if known is None else known.where(F.col("description") == description).orderBy(F.desc("ts")).first()
    if row is None:
        stats = key_stats(df, key, measure, by) if measure else key_counts(df, key)
        target = f"{path}/stats-{uuid.uuid4().hex}"
        stats.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by).parquet(target)
        done = spark.range(1).select(F.lit(description).alias("description"), F.lit(target).alias("target"), F.current_timestamp().alias("ts"))
        done.write.mode("append").parquet(f"{path}/contents")
    else:
        target = row["target"]
    return spark.read.parquet(target)
