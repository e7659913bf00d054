"""Repeatable random decisions from row and key values.

Every sampling decision is ``hash(values) < rate``. The hash has 62 bits. The upper ones are a random polynomial over the
integers modulo the prime 2^31 - 1 (Carter-Wegman hashing): over the choice of coefficients, two different keys get
independent values, which is what the variance formulas assume, and keys that differ in their low 31 bits get four-wise
independent values, which is what the +-1 join sketches assume. The lower bits are ``xxhash64`` of the same values; they
only decide for rows at the border of a rate.

The coefficients of a replicate come from a counter-based generator: ``xxhash64`` of a number per coefficient plus the
replicate's. Replicates are independent of each other, so spreads measured over them can be trusted, and a plan holds one
number per coefficient, however many replicates it draws.

A decision depends only on the values and the coefficients. It is the same on a retried task, after a repartition
and on both sides of a join. Each term uses its input once, so the expression stays small and inside generated code,
and all products stay below 2^63, as ANSI arithmetic demands.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = 2**31 - 1
BITS = 31
#: Hashes of 62 bits are below this number, which a double holds exactly.
RANGE = PRIME * 2**BITS
DRAW_KEY = ("preset", "replicate")
#: The seed of Spark's ``xxhash64``.
SPARK_SEED = 42
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def hash_values(df: DataFrame, columns: Sequence[str], as_type: T.DataType | None = None) -> list[Column]:
    """The named columns as 64-bit numbers; other than integral types go through ``xxhash64`` first.

    ``as_type`` is the type in which the columns are compared with those of another table.
    """
    values = []
    for name in columns:
        kind = as_type or df.schema[name].dataType
        value = F.col(name) if as_type is None else F.col(name).cast(as_type)
        if isinstance(kind, _INTEGRAL):
            value = F.coalesce(value.cast("long"), F.lit(-1).cast("long"))
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            value = F.xxhash64(value + F.lit(0.0))  # -0.0 and 0.0 are equal in a join
        else:
            value = F.xxhash64(value)
        values.append(value)
    return values


def hash_parts(df: DataFrame, columns: Sequence[str], as_type: T.DataType | None = None) -> list[Column]:
    """31-bit parts of ``hash_values``."""
    parts = []
    for value in hash_values(df, columns, as_type):
        parts.append(value.bitwiseAND(F.lit(PRIME)))
        parts.append(F.shiftright(value, BITS).bitwiseAND(F.lit(PRIME)))
    return parts


def comparison_type(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> T.DataType | None:
    """The type in which a join compares two keys; ``None`` if they have the same type already."""
    one, two = left.schema[left_key].dataType, right.schema[right_key].dataType
    if one == two or (isinstance(one, _INTEGRAL) and isinstance(two, _INTEGRAL)):
        return None
    empty = left.sparkSession.range(0)
    try:
        both = empty.select(F.coalesce(F.lit(None).cast(one), F.lit(None).cast(two)).alias("key"))
        return both.schema["key"].dataType
    except AnalysisException as error:
        raise ValueError(f"keys of types {one.simpleString()} and {two.simpleString()} cannot be joined") from error


def polynomial_hash(parts: Sequence[Column], coefficient: Callable[[int], Column]) -> Column:
    """Cubic in the first part, linear in the others, modulo ``PRIME``."""
    first, *others = parts
    value = coefficient(3)
    for i in (2, 1, 0):
        value = (value * first + coefficient(i)) % PRIME
    for i, part in enumerate(others):
        value = (value + coefficient(4 + i) * part) % PRIME
    return value


def fine_hash(df: DataFrame, columns: Sequence[str], role: str, draw: Callable[[str], Column], as_type: T.DataType | None = None) -> Column:
    """62 bits below ``RANGE``: the polynomial, then bits that tell rows with equal polynomials apart."""
    value = polynomial_hash(hash_parts(df, columns, as_type), lambda i: draw(f"{role}_{i}"))
    lower = F.xxhash64(draw(f"{role}_tie"), *hash_values(df, columns, as_type)).bitwiseAND(F.lit(PRIME))
    return value * F.lit(2**BITS) + lower


def limit_of(rate: Column) -> Column:
    """Hashes below this are kept at ``rate``: none at 0, all at 1 and above. NULL for no rate, which keeps none."""
    return F.ceil(F.when(rate >= 1.0, F.lit(1.0)).otherwise(rate) * F.lit(float(RANGE)))


def coefficients_needed(columns: int) -> int:
    """Coefficients of a hash over this many columns (two parts each)."""
    return 4 + 2 * columns - 1


@lru_cache(maxsize=10_000)
def stream(seed: int, role: str, i: int | str) -> int:
    """Where a coefficient's counter starts: the replicate's number is added to it."""
    return random.Random(f"{seed}/{role}/{i}").getrandbits(BITS * 2)


def draw_coefficients(seed: int, role: str, replicate: int, n: int) -> list[int]:
    """``n`` coefficients for one role of one replicate, as ``Draws.coefficient`` has them."""
    counters = (stream(seed, role, i) + replicate for i in range(n))
    return [xxhash.xxh64_intdigest(c.to_bytes(8, "little"), SPARK_SEED) & PRIME for c in counters]


def unit_interval(hashed: Column) -> Column:
    """Map a hash value to [0, 1)."""
    return hashed / F.lit(float(PRIME))


@dataclass(frozen=True)
class Draws:
    """The random draws behind a set of samples: one row per (preset, replicate).

    ``roles`` gives the number of coefficients per hash. ``constants`` are per-preset literal columns, such as the
    rates of a preset sweep.
    """

    seed: int
    replicates: tuple[int, ...]
    roles: Mapping[str, int]
    constants: tuple[Mapping[str, float], ...] = ({},)

    def rows(self) -> list[dict]:
        table = []
        for preset, constant in enumerate(self.constants):
            for replicate in self.replicates:
                row: dict = {"preset": preset, "replicate": replicate}
                row.update(constant)
                for role, n in self.roles.items():
                    values = draw_coefficients(self.seed, role, replicate, n)
                    row.update({f"{role}_{i}": value for i, value in enumerate(values)})
                table.append(row)
        return table

    def attach(self, df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
        """``df`` once per draw, and a function from a draw field's name to its Column.

        Presets are a short literal array and replicates a sequence, unfolded inside the scan's generated code, so a
        row is tested against every draw without being copied; rows are built only for the draws that keep them. The
        plan is as large for thousands of replicates as for two.
        """
        if len(self.constants) * len(self.replicates) == 1:
            only = self.rows()[0]
            kept = df.withColumns({name: F.lit(only[name]).cast("int") for name in DRAW_KEY})
            return kept, lambda name: F.expr(_literal(name, only[name])) if name in only else self.coefficient(name)
        fanned = df.select("*", F.inline(self._presets()).alias("preset", *[_field(n) for n in self.constants[0]]))
        fanned = fanned.select("*", F.explode(self._numbers()).alias("replicate"))
        return fanned, lambda name: F.col(_field(name)) if name in self.constants[0] else self.coefficient(name)

    def coefficient(self, name: str) -> Column:
        """The coefficient ``role_i`` of the draw that the column ``replicate`` names; ``role_tie`` is a plain counter."""
        role, _, i = name.rpartition("_")
        counter = f"cast(replicate AS BIGINT) + {stream(self.seed, role, i if i == 'tie' else int(i))}L"
        return F.expr(counter if i == "tie" else f"xxhash64({counter}) & {PRIME}L")

    def _presets(self) -> Column:
        return literal_rows([{"preset": number, **constant} for number, constant in enumerate(self.constants)])

    def _numbers(self) -> Column:
        first, last = self.replicates[0], self.replicates[-1]
        if self.replicates == tuple(range(first, last + 1)):
            return F.expr(f"sequence({first}, {last})")
        return F.expr(f"array({', '.join(map(str, self.replicates))})")

    def table(self, spark: SparkSession) -> DataFrame:
        """The identities of the draws: (preset, replicate) and the constants."""
        presets = spark.range(1).select(F.inline(self._presets()))
        columns = ["preset", "replicate", *self.constants[0]]
        return presets.select("*", F.explode(self._numbers()).alias("replicate")).select(*columns)

    def identities(self) -> Column:
        """The (preset, replicate) pairs as an array, to be unfolded with ``inline``."""
        presets = F.sequence(F.lit(0), F.lit(len(self.constants) - 1))

        def of(preset: Column) -> Column:
            return F.transform(self._numbers(), lambda r: F.struct(preset.alias("preset"), r.alias("replicate")))

        return F.flatten(F.transform(presets, of))


def literal_rows(rows: Sequence[Mapping]) -> Column:
    """A literal array of structs, handed to Spark as one expression text rather than one call per number."""
    structs = ("named_struct(" + ", ".join(f"'{k}', {_literal(k, v)}" for k, v in row.items()) + ")" for row in rows)
    return F.expr(f"array({', '.join(structs)})")


def _field(name: str) -> str:
    return name if name in DRAW_KEY else f"_draw_{name}"


def _literal(name: str, value) -> str:
    if name in DRAW_KEY:
        return f"{value}"
    return f"{value!r}D" if isinstance(value, float) else f"{value}L"
