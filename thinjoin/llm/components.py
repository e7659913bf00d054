"""Connected components as joins and aggregates: alternating large and small stars.

Every round settles its tables in the shared folder, so lost executors cost a round at most and no plan grows with the
number of rounds. Nothing but a two-number fingerprint of the edges reaches the driver. A hub with a third of all edges
is aggregated before the shuffle where its minimum is taken, and its edges meet one row in a join of two settled
tables, which Spark splits where a partition is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinjoin.session import settle


def downward(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges as (u, v) with u > v; loops and edges with a null end are left out."""
    pairs = edges.where(F.col(a) != F.col(b))
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; ``component`` is the smallest node that it is connected to."""
    now = settle(downward(edges, a, b), "edges")
    mark = fingerprint(now)
    while mark[0]:
        both = now.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            now.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = settle(least.select("node", F.least("node", "least").alias("least")), "large-star")
        raised = both.where(F.col("other") > F.col("node")).join(least, "node")
        large = settle(raised.select(F.col("other").alias("u"), F.col("least").alias("v")).distinct(), "edges")
        least = settle(large.groupBy("u").agg(F.min("v").alias("least")), "small-star")
        lowered = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = lowered.where(F.col("u") != F.col("v")).unionByName(least.withColumnRenamed("least", "v"))
        now = settle(small.distinct(), "edges")
        before, mark = mark, fingerprint(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
