"""Experiments: draw, estimate and append, in steps that can be run again.

An experiment has a folder. Samples are stored there once per configuration and replicate, exact answers once per
configuration, predicate value or group, and results in tables where a unit (a configuration with a replicate, a value, a
group) stands once. Every step first asks what is missing and adds that as a batch which counts as a whole or not at
all, so a run that died is continued by running it again, with more replicates, values or groups if wanted; what is
there is neither drawn nor estimated again. The names of the tables stand for their content: results of changed data belong
in another folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.evaluation.runs import AGGREGATES, results
from thinjoin.functions.hashing import DRAW_KEY
from thinjoin.functions.rates import Rates
from thinjoin.operators.estimate import estimates
from thinjoin.operators.exact import as_doubles, exact_join_agg
from thinjoin.operators.filters import filtered_answers, filtered_estimates
from thinjoin.operators.sampling import RateSource, SamplePair, Side, fixed_rates
from thinjoin.operators.stratified import GroupedSample, sample_draws, universe_strata_estimates, universe_strata_pair
from thinjoin.sources.catalog import META_IDENTITY, REPLICATES_PER_JOB, load_pair, store_pair
from thinjoin.sources.committed import CommittedTable

PAIR = ("left_dist", "right_dist", "t1_join_col", "t2_join_col", "t1_agg_col")
DRAWN = ("p", "q1", "q2", "seed", "preset", "idx")
RUN = (*PAIR, *DRAWN)
FILTERED_RUN = (*PAIR, "where_col", "cond_type", *DRAWN, "cond_val")
BUDGET = ("query", "e1", "e2", "key_t", "row_t", "seed")
GROUPED = (*PAIR, "group_col", *BUDGET)
_ACTUALS = tuple(f"{agg}_actual" for agg in AGGREGATES)


def _named(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """``df`` with the constants of a configuration in front."""
    kinds = {str: "string", int: "long", float: "double"}
    return df.select(*[F.lit(v).cast(kinds[type(v)]).alias(n) for n, v in values.items()], *df.columns)


def _of(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def _portions(numbers: Sequence[int]) -> Iterator[list[int]]:
    for start in range(0, len(numbers), REPLICATES_PER_JOB):
        yield list(numbers[start : start + REPLICATES_PER_JOB])


@dataclass(frozen=True)
class GroupBudget:
    """What a grouped sample is planned for: the aggregate, shares of both tables, keys of a major group, rows per group."""

    query: str
    e1: float
    e2: float
    key_t: float
    row_t: float


@dataclass(frozen=True)
class Experiment:
    """A pair of tables under the names that results have them by."""

    left: Side
    right: Side
    left_name: str
    right_name: str
    measure: str
    folder: str
    seed: int = 1

    # ------------------------------------------------------------ tables

    @property
    def spark(self) -> SparkSession:
        return self.left.table.sparkSession

    def table(self, name: str, unit: Sequence[str]) -> CommittedTable:
        return CommittedTable(f"{self.folder}/{name}", tuple(unit))

    def _pair(self) -> dict:
        return dict(zip(PAIR, (self.left_name, self.right_name, self.left.key, self.right.key, self.measure), strict=True))

    def _identity(self) -> dict[str, str]:
        of = (self.left_name, self.right_name, "all", self.left.key, self.right.key, self.measure)
        return dict(zip(META_IDENTITY, of, strict=True))

    def _runs(self, rates: RateSource, replicates: int) -> DataFrame:
        """The wanted (configuration, replicate) rows: columns ``RUN``."""
        every = [rates] if isinstance(rates, Rates) else list(rates)
        presets = [(i, r.p, r.q1, r.q2) for i, r in enumerate(every)]
        rows = self.spark.createDataFrame(presets, "preset int, p double, q1 double, q2 double")
        numbers = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("idx")
        return _named(rows.select("p", "q1", "q2", F.lit(self.seed).cast("long").alias("seed"), "preset", numbers), self._pair())

    def _rate_columns(self, rates: RateSource) -> dict[str, Column]:
        if isinstance(rates, Rates):
            found = {n: F.lit(getattr(rates, n)) for n in ("p", "q1", "q2")}
        else:
            found = {n: F.element_at(F.array(*[F.lit(getattr(r, n)) for r in rates]), F.col("preset") + 1) for n in ("p", "q1", "q2")}
        return {n: c.cast("double") for n, c in found.items()} | {"seed": F.lit(self.seed).cast("long")}

    # ------------------------------------------------------------ samples

    def draw(self, rates: RateSource | DataFrame, replicates: int) -> RateSource:
        """Store the replicates that are not there yet; the rates as numbers."""
        rates = fixed_rates(rates)
        store_pair(self.left, self.right, rates, f"{self.folder}/samples", replicates, self._identity(), self.seed)
        return rates

    def sample(self, rates: RateSource, numbers: Sequence[int]) -> SamplePair:
        return load_pair(self.left, self.right, f"{self.folder}/samples", numbers, self._identity(), rates, self.seed)

    # ------------------------------------------------------------ plain runs

    def _actual(self) -> DataFrame:
        """The exact answers, computed on first use."""
        table = self.table("actuals", PAIR)
        found = exact_join_agg(self.left.table, self.right.table, self.left.key, self.right.key, self.measure)
        table.add(_named(found, self._pair()), _named(self.spark.range(1).select(), self._pair()))
        return _of(table.read(self.spark), self._pair())

    def run(self, rates: RateSource | DataFrame, replicates: int) -> DataFrame:
        """COUNT, SUM and AVG of replicates 1 to ``replicates`` beside the exact answers: table ``results``."""
        rates = self.draw(rates, replicates)
        table, wanted = self.table("results", RUN), self._runs(rates, replicates)
        for numbers in _portions(_numbers(table.missing(wanted))):
            pair = self.sample(rates, numbers)
            rows = results(estimates(pair, self.measure), self._actual(), self.left_name, self.right_name, self._rate_columns(rates))
            table.add(self._stamped(rows), wanted.where(F.col("idx").isin(numbers)))
        return _chosen(table, wanted)

    def _stamped(self, rows: DataFrame) -> DataFrame:
        return _named(rows.drop("left_dist", "right_dist"), self._pair()).withColumn("ts", F.current_timestamp())

    # ------------------------------------------------------------ runs under a predicate

    def run_where(self, rates: RateSource | DataFrame, replicates: int, column: str, op: str, values: Sequence[int]) -> DataFrame:
        """As ``run`` for every value of a predicate on the left table, from the same samples: table ``where_results``."""
        rates = self.draw(rates, replicates)
        where = {"where_col": column, "cond_type": op}
        listed = F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias("cond_val")
        known = self.table("where_actuals", (*PAIR, *where, "cond_val"))
        asked = _named(self.spark.range(1).select(listed), self._pair() | where)
        absent = sorted(r["cond_val"] for r in known.missing(asked).collect())
        if absent:
            sides = self.left.table, self.right.table, self.left.key, self.right.key
            known.add(_named(filtered_answers(*sides, self.measure, column, op, absent), self._pair() | where), asked)
        table = self.table("where_results", FILTERED_RUN)
        wanted = _named(self._runs(rates, replicates).select(*DRAWN, listed), self._pair() | where)
        actual = as_doubles(_of(known.read(self.spark), self._pair() | where).select("cond_val", *_ACTUALS))
        for numbers in _portions(_numbers(table.missing(wanted))):
            part = wanted.where(F.col("idx").isin(numbers))
            of = sorted(r["cond_val"] for r in table.missing(part).select("cond_val").distinct().collect())
            found = filtered_estimates(self.sample(rates, numbers), self.measure, column, op, of).join(actual, "cond_val")
            rows = _long(found, self._rate_columns(rates), ["cond_val"])
            table.add(_named(rows, self._pair() | where).withColumn("ts", F.current_timestamp()), part)
        return _chosen(table, wanted)

    # ------------------------------------------------------------ runs by group

    def _grouped(self, group: str, budget: GroupBudget) -> dict:
        of = budget.query, float(budget.e1), float(budget.e2), float(budget.key_t), float(budget.row_t), self.seed
        return self._pair() | {"group_col": group} | dict(zip(BUDGET, of, strict=True))

    def group_sample(self, group: str, budget: GroupBudget, parameters: DataFrame, replicates: int) -> tuple[GroupedSample, DataFrame]:
        """The stored universe strata and their parameters; replicates that are not there are drawn.

        ``parameters`` (``plans.strata.group_parameters``) is evaluated once for a configuration, and kept.
        """
        names = self._grouped(group, budget)
        known = self.table("groupinfo", GROUPED)
        known.add(_named(parameters, names), _named(self.spark.range(1).select(), names))
        plan = _of(known.read(self.spark), names).select(*parameters.columns)
        sides = {s: self.table(f"strata_{s}", (*GROUPED, *DRAW_KEY)) for s in ("left", "right")}
        every = self.spark.range(1, replicates + 1).select(F.lit(0).alias("preset"), F.col("id").cast("int").alias("replicate"))
        wanted = _named(every, names)
        absent = sides["left"].missing(wanted).unionByName(sides["right"].missing(wanted))
        for numbers in _portions(_numbers(absent, "replicate")):
            drawn = universe_strata_pair(self.left, self.right, group, plan, numbers, self.seed)
            part = wanted.where(F.col("replicate").isin(numbers))
            for name, rows in (("left", drawn.left), ("right", drawn.right)):
                # columns of the tables may have names of the configuration
                held = rows.select(*DRAW_KEY, F.struct(*[c for c in rows.columns if c not in DRAW_KEY]).alias("row"))
                sides[name].add(_named(held, names), part)
        held = [_of(sides[s].read(self.spark), names).select(*DRAW_KEY, "row.*") for s in ("left", "right")]
        draws = sample_draws(self.left, self.right, replicates, self.seed)
        return GroupedSample(*held, self.left.key, self.right.key, group, plan, draws), plan

    def run_groups(
        self, group: str, budget: GroupBudget, parameters: DataFrame, replicates: int, groups: Sequence | None = None
    ) -> DataFrame:
        """As ``run`` for every group of a column of the left table, NULL included: table ``strat_results``.

        The samples are universe strata, drawn for all groups; ``groups`` limits what is estimated now. An estimate is
        NULL where the plan has no rate for the group.
        """
        names = self._grouped(group, budget)
        sample, plan = self.group_sample(group, budget, parameters, replicates)
        chosen = plan if groups is None else plan.where(_among(F.col("grp"), groups))
        known = self.table("strat_actuals", (*PAIR, "group_col"))
        exact = exact_join_agg(self.left.table, self.right.table, self.left.key, self.right.key, self.measure, group)
        of = {n: names[n] for n in (*PAIR, "group_col")}
        known.add(_named(exact.withColumnRenamed(group, "grp"), of), _named(self.spark.range(1).select(), of))
        actual = as_doubles(_of(known.read(self.spark), of).select(F.col("grp").alias("_grp"), *_ACTUALS))
        table = self.table("strat_results", (*GROUPED, "grp", "idx"))
        numbers = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("idx")
        wanted = _named(chosen.select("grp", numbers), names)
        for some in _portions(_numbers(table.missing(wanted))):
            part = GroupedSample(
                sample.left.where(F.col("replicate").isin(some)),
                sample.right.where(F.col("replicate").isin(some)),
                *(sample.left_key, sample.right_key, sample.group, chosen),
                sample_draws(self.left, self.right, some, self.seed),
            )
            found = universe_strata_estimates(part, self.measure)
            found = found.join(actual, F.col("grp").eqNullSafe(F.col("_grp")), "left").fillna(0.0, list(_ACTUALS))
            rows = _long(found, {}, ["grp", "seen", "status"]).drop("preset").withColumnRenamed("query", "answer")
            table.add(_named(rows, names).withColumn("ts", F.current_timestamp()), wanted.where(F.col("idx").isin(some)))
        return _chosen(table, wanted)


def _numbers(missing: DataFrame, name: str = "idx") -> list[int]:
    return sorted(r[0] for r in missing.select(name).distinct().collect())


def _chosen(table: CommittedTable, wanted: DataFrame) -> DataFrame:
    return CommittedTable._of_units(table.read(wanted.sparkSession), wanted, table.unit)


def _among(column: Column, values: Sequence) -> Column:
    found = column.isin([v for v in values if v is not None])
    return (F.coalesce(found, F.lit(False)) | column.isNull()) if None in values else F.coalesce(found, F.lit(False))


def _long(found: DataFrame, rates: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per aggregate, with the replicate as ``idx``."""
    rows = [F.struct(F.lit(a).alias("query"), F.col(f"{a}_actual").alias("actual"), F.col(f"{a}_estimate").alias("estimate")) for a in AGGREGATES]
    return found.select(
        "preset", F.col("replicate").alias("idx"), *keep, *[c.alias(n) for n, c in rates.items()], F.inline(F.array(*rows))
    )
