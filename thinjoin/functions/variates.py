"""Random variates as Columns over a row identity: the same rows come out on a retried task or another cluster."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from thinjoin.functions.hashing import BITS, PRIME, draw_coefficients, polynomial_hash

# Exponent of the power-law key distributions by name.
POWER_LAWS = {"powerlaw": -1.5, "powerlaw1": -2.5, "powerlaw2": -3.0, "powerlaw3": -2.0}
# Keys / standard deviation of the truncated-normal key distributions by name.
NORMAL_SPREADS = {"normal": 5, "normal1": 10, "normal2": 20}
TRIES = 4


def _lane(row: Column, seed: int, role: str) -> Column:
    value = row.cast("long")
    parts = [value.bitwiseAND(F.lit(PRIME)), F.shiftright(value, BITS).bitwiseAND(F.lit(PRIME))]
    numbers = draw_coefficients(seed, role, 0, 5)
    return polynomial_hash(parts, lambda i: F.lit(numbers[i]).cast("long"))


def coarse_uniform(row: Column, seed: int, role: str) -> Column:
    """Uniform in [0, 1) with 31 bits, enough where the result is rounded to a coarser grid."""
    return _lane(row, seed, role) / F.lit(float(PRIME))


def uniform(row: Column, seed: int, role: str) -> Column:
    """Uniform in [0, 1) from an integral row identity, with the resolution of a double."""
    high, low = _lane(row, seed, f"{role}.high"), _lane(row, seed, f"{role}.low")
    return (high + low / F.lit(float(PRIME))) / F.lit(float(PRIME))


def uniform_int(row: Column, seed: int, role: str, low: int, n: Column) -> Column:
    """Uniform integer in ``low .. low + n - 1``."""
    return F.floor(uniform(row, seed, role) * n).cast("long") + low


def standard_normal(row: Column, seed: int, role: str) -> Column:
    """Box-Muller. Few operations, so that the code of a whole projection stays small enough to be compiled."""
    radius = F.sqrt(-2 * F.log(1 - coarse_uniform(row, seed, f"{role}.radius")))
    return radius * F.cos(2 * math.pi * coarse_uniform(row, seed, f"{role}.angle"))


def truncated_normal(row: Column, seed: int, role: str, mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """Normal conditioned on [low, high]: the first of several draws inside, clamped if none is.

    With two and a half standard deviations on each side a draw is outside with probability 0.0124, so the clamp acts
    on one row in forty million, and on none in practice for the narrower distributions.
    """
    draws = [mean + sd * standard_normal(row, seed, f"{role}.{i}") for i in range(TRIES)]
    middle, half = (low + high) / 2, (high - low) / 2
    inside = [F.when(F.abs(d - middle) <= half, d) for d in draws]
    return F.coalesce(*inside, F.least(high, F.greatest(low, draws[-1])))


def power_law(row: Column, seed: int, role: str, alpha: float, high: Column) -> Column:
    """Integer power law on 1..high by inverse distribution function."""
    k = alpha + 1
    value = F.pow(uniform(row, seed, role) * (F.pow(high, F.lit(k)) - 1) + 1, F.lit(1 / k))
    return F.least(F.floor(value).cast("long"), high.cast("long"))


def relabel_numbers(seed: int) -> tuple[int, int]:
    """Multiplier and shift of a seed's permutation; the multiplier is a prime between 2^30 and 2^31."""
    source = random.Random(f"{seed}/relabel")
    while True:
        number = source.randrange(2**30 + 1, 2**31, 2)
        if all(number % d for d in range(3, 46341, 2)):
            return number, source.randrange(2**30)


def relabel(value: Column, n: Column, seed: int) -> Column:
    """A permutation of 1..n (n up to 2^30) drawn from the seed, so that frequent keys are spread over the labels.

    Multiplication by a prime above ``n`` permutes the residues. Two seeds give unrelated multipliers, so the frequent
    keys of two tables meet by chance only.
    """
    number, shift = relabel_numbers(seed)
    return ((value - 1) * F.lit(number).cast("long") + F.lit(shift).cast("long")) % n.cast("long") + 1


def keys(row: Column, seed: int, distribution: str, n: Column) -> Column:
    """Join keys 1..n under a named distribution, before relabelling."""
    if distribution == "uniform":
        return uniform_int(row, seed, "key", 1, n)
    if distribution in NORMAL_SPREADS:
        sd = n / NORMAL_SPREADS[distribution]
        value = truncated_normal(row, seed, "key", n / 2, sd, F.lit(1.0), n.cast("double"))
        return F.round(value).cast("long")
    if distribution in POWER_LAWS:
        return power_law(row, seed, "key", POWER_LAWS[distribution], n)
    raise ValueError(f"unknown key distribution: {distribution}")


def related_value(row: Column, seed: int, relation: str, key: Column, n: Column, values: int) -> Column:
    """A predicate column with ``values`` distinct values, independent of the key or correlated with it."""
    noise = standard_normal(row, seed, "noise") * 100
    whole_noise = noise.cast("long")
    width = n / values
    if relation == "uniform":
        value = uniform_int(row, seed, "predicate", 0, F.lit(values))
    elif relation == "normal":
        middle = F.lit(values / 2)
        drawn = truncated_normal(row, seed, "predicate", middle, F.lit(values / 10), F.lit(0.0), F.lit(float(values)))
        value = F.round(drawn).cast("long")
    elif relation in ("powerlaw", "powerlaw2"):
        alpha = {"powerlaw": -1.5, "powerlaw2": -2.5}[relation]
        value = power_law(row, seed, "predicate", alpha, F.lit(values + 1)) - 1
    elif relation == "positive":
        value = F.floor((key + whole_noise) / width).cast("long")
    elif relation == "negative":
        value = F.floor((n + 1 - key + whole_noise) / width).cast("long")
    else:
        raise ValueError(f"unknown relation: {relation}")
    return F.least(F.greatest(value, F.lit(0)), F.lit(values - 1)).cast("long")
