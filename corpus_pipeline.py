"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last adds each document's sampling
probability. ``run`` writes every stage's result as Parquet in the shared folder and reads it back, so a lost executor
costs the current stage. Nulls, empty and very long texts, repeated rows, empty tables and extra columns have the results
that each operator defines; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thinjoin.llm import contamination, language_id, line_dedup, mixing, near_dedup
from thinjoin.llm.common import table, unpacked
from thinjoin.session import settle

#: Share of the best language below which a document's language counts as not recognised.
LEAST_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    found = language_id.identify(docs, language_id.learn(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return unpacked(kept, docs.columns)


def with_text(found: DataFrame, docs: DataFrame, text: str, changed: Column) -> DataFrame:
    """The columns of ``docs`` with the text from column ``text``, and its ``n_chars`` where it ``changed``."""
    if "n_chars" not in docs.columns:
        return unpacked(found, docs.columns, text)
    kind = docs.schema["n_chars"].dataType
    length = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("row.n_chars"))
    return unpacked(found.withColumn("row", F.col("row").withField("n_chars", length)), docs.columns, text)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    found = line_dedup.line_dedup(docs)
    return with_text(found, docs, "kept", F.col("n_dropped") > 0)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return unpacked(near_dedup.representatives(docs), docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items, without the long spans they share with them."""
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    kept = found.where(~F.col("contaminated"))
    return with_text(kept, docs, "clean", ~F.col("clean").eqNullSafe(F.col("text")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents and their ``mix_probability``."""
    found = mixing.mix(docs).where("sampled")
    columns = [F.col(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "mix_probability"]
    return found.select(*columns, F.col("probability").alias("mix_probability"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Learned and iterative stages are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
