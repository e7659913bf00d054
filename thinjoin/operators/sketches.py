"""+-1 sketches of a join's inner products.

Each sketch gives every key a random sign and sums each side's per-key values times the sign. The product of the two
sides' sums is an unbiased estimate of the inner product; the average over many sketches is reported. Only as many
rows as there are sketches leave each side, so the two tables' statistics need not be joined. A key is added to every
sketch, so this is for few of them.

A bucketed sketch adds a key to one of ``width`` buckets, with a sign, in each of a few hash rows: the work per key
does not depend on the width. The sum over a row's buckets of the two sides' products estimates the inner product with the
variance that ``width`` plain sketches have, and the median over the rows makes a large error improbable. Sketches of two parts of a table add up bucket by
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinjoin.functions.hashing import Draws, coefficients_needed, hash_parts, polynomial_hash
from thinjoin.operators.moments import MOMENTS

# Left and right per-key features whose inner product is each moment.
_LEFT = {"a": "a", "a2": "a*a", "x": "x", "x2": "x*x", "s": "s", "s2": "s*s", "q": "q", "xs": "x*s"}
_RIGHT = {"b": "b", "b2": "b*b"}


def sketch_side(stats: DataFrame, features: dict[str, Column], sketches: int, seed: int) -> DataFrame:
    """One row per sketch: the signed sum of each feature over the keys."""
    draws = Draws(seed, tuple(range(1, sketches + 1)), {"sign": coefficients_needed(1)})
    fanned, draw = draws.attach(stats)
    hashed = polynomial_hash(hash_parts(stats, ["key"]), lambda i: draw(f"sign_{i}"))
    sign = (hashed.bitwiseAND(F.lit(1)) * 2 - 1).cast("double")
    signed = fanned.withColumn("_sign", sign)
    sums = [F.sum(value * F.col("_sign")).alias(name) for name, value in features.items()]
    return signed.groupBy(F.col("replicate").alias("sketch")).agg(*sums)


def sketched_join_size(left_counts: DataFrame, right_counts: DataFrame, sketches: int, seed: int = 1) -> DataFrame:
    """Estimate of the number of joined rows, the average over the sketches."""
    left = sketch_side(left_counts, {"u": F.col("a")}, sketches, seed)
    right = sketch_side(right_counts, {"v": F.col("b")}, sketches, seed)
    products = left.join(right, "sketch").select((F.col("u") * F.col("v")).alias("product"))
    return products.agg(F.coalesce(F.avg("product"), F.lit(0.0)).alias("n_join"))


def sketched_moments(
    left_stats: DataFrame, right_counts: DataFrame, sketches: int, seed: int = 1, names: Sequence[str] = MOMENTS
) -> DataFrame:
    """All moments estimated from one set of sketches; feeds the planners as exact moments do."""
    left = sketch_side(left_stats, {f"u_{n}": F.expr(e) for n, e in _LEFT.items()}, sketches, seed)
    right = sketch_side(right_counts, {f"v_{n}": F.expr(e) for n, e in _RIGHT.items()}, sketches, seed)
    both = left.join(right, "sketch")
    sums = [F.avg(F.col(f"u_{u}") * F.col(f"v_{v}")).alias(n) for n, (u, v) in _split(names).items()]
    return both.agg(*sums)


ROWS, WIDTH = 5, 200


def bucket_sketch(stats: DataFrame, features: dict[str, Column], width: int = WIDTH, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(row, bucket) and the signed sum of each feature over the keys of the bucket; buckets without keys have no row.

    Bucket and sign are bits of one four-wise independent hash.
    """
    draws = Draws(seed, tuple(range(1, rows + 1)), {"sign": coefficients_needed(1)})
    fanned, draw = draws.attach(stats)
    hashed = polynomial_hash(hash_parts(stats, ["key"]), lambda i: draw(f"sign_{i}")).alias("_hash")
    held = fanned.select("replicate", hashed, *[value.alias(name) for name, value in features.items()])
    sign = (F.col("_hash").bitwiseAND(F.lit(1)) * 2 - 1).cast("double")
    sums = [F.sum(F.col(name) * sign).alias(name) for name in features]
    bucket = (F.shiftright("_hash", 1) % F.lit(width)).cast("int").alias("bucket")
    return held.groupBy(F.col("replicate").alias("row"), bucket).agg(*sums)


def merged_sketches(one: DataFrame, *others: DataFrame) -> DataFrame:
    """The sketch of all the parts that these are sketches of, made with one width, number of rows and seed.

    The parts must not share keys where a feature is not additive (squares).
    """
    whole = one
    for other in others:
        whole = whole.unionByName(other)
    names = [c for c in one.columns if c not in ("row", "bucket")]
    return whole.groupBy("row", "bucket").agg(*[F.sum(n).alias(n) for n in names])


def inner_products(left: DataFrame, right: DataFrame, products: dict[str, tuple[str, str]], rows: int = ROWS) -> DataFrame:
    """One row: the median over the hash rows of each product of a left and a right feature."""
    both = left.join(right, ["row", "bucket"])
    per_row = both.groupBy("row").agg(*[F.sum(F.col(u) * F.col(v)).alias(n) for n, (u, v) in products.items()])
    every = left.sparkSession.range(1, rows + 1).select(F.col("id").cast("int").alias("row"))
    filled = every.join(per_row, "row", "left").fillna(0.0, list(products))
    return filled.agg(*[F.median(n).alias(n) for n in products])


def bucketed_join_size(left_counts: DataFrame, right_counts: DataFrame, width: int = WIDTH, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """Estimate of the number of joined rows."""
    left = bucket_sketch(left_counts, {"u": F.col("a")}, width, rows, seed)
    right = bucket_sketch(right_counts, {"v": F.col("b")}, width, rows, seed)
    return inner_products(left, right, {"n_join": ("u", "v")}, rows)


def bucketed_moments(
    left_stats: DataFrame, right_counts: DataFrame, width: int = WIDTH, rows: int = ROWS, seed: int = 1, names: Sequence[str] = MOMENTS
) -> DataFrame:
    """All moments from one bucketed sketch of either side; feeds the planners as exact moments do."""
    left = bucket_sketch(left_stats, {f"u_{n}": F.expr(e) for n, e in _LEFT.items()}, width, rows, seed)
    right = bucket_sketch(right_counts, {f"v_{n}": F.expr(e) for n, e in _RIGHT.items()}, width, rows, seed)
    return inner_products(left, right, {n: (f"u_{u}", f"v_{v}") for n, (u, v) in _split(names).items()}, rows)


def _split(names: Sequence[str]) -> dict[str, tuple[str, str]]:
    """'s2b2' -> ('s2', 'b2')."""
    return {n: (n[: n.index("b")], n[n.index("b") :]) for n in names}
