"""Small helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thinjoin.session import settle

#: Bytes of text a Python task handles at a time; keeps its arrays to a few dozen MB whatever the batch Spark sends.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``text`` as UTF-8 bytes (null stays null)."""
    return docs.select(*keep, F.col("text").cast("binary").alias("text"))


def folded_crc(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``: the folds of labelled rows. Null falls in no fold."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``limit`` bytes of ``column`` each; a longer row is a part of its own."""
    at = batch.schema.get_field_index(column)
    sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(at)).to_pylist()], np.int64)
    block = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def packed(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but the text in one struct, so that no column of the input meets one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), F.col("text"))


def unpacked(found: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The input's columns again, in their order, with ``text`` taken from the column named."""
    return found.select(*[F.col(text).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns])


def map_text(rows: DataFrame, work: Callable[[], Callable[[list], list[pa.Array]]], results: str) -> DataFrame:
    """``rows`` of (row, text), and result columns that an Arrow function derives from the text.

    ``work()`` runs once per task; what it returns gets the texts of a slice as a list of bytes (or None) and gives one
    array per field of ``results`` (a schema string).
    """
    fields = StructType.fromDDL(results)
    schema = StructType([*rows.select("row").schema.fields, *StructType.fromDDL("text BINARY").fields, *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = None
        for batch in batches:
            if batch.num_rows:
                handle = handle or work()
                for part in slices(batch):
                    text = part.column("text")
                    found = handle(text.to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("row"), text, *found], names=schema.names)

    mapped = rows.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    return mapped.withColumn("text", F.col("text").cast("string"))


def shared_sample(df: DataFrame, by: Column, per_group: int, *keys: str) -> DataFrame:
    """About ``per_group`` rows of each value of ``by``, chosen by a hash of the columns ``keys``; adds ``_group``.

    The group sizes are counted first, as a table whose size Spark knows, so that no row is moved: a row stays if its hash falls in the share that leaves
    ``per_group`` rows. The same rows are chosen whenever the same table is read.
    """
    rows = df.withColumn("_group", by).where(F.col("_group").isNotNull())
    sizes = settle(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")), "group-sizes")
    share = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(sizes, "_group").where(share * F.col("_size") < per_group).drop("_size")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, bytes]]:
    """(label, text) of about ``per_class`` labelled documents of either class, in a fixed order.

    The sample is taken from the labels, so its size is known before any text is read, and it is small enough to be
    sent to the scan of the documents whatever their number. A document labelled twice has its larger label.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = shared_sample(one, F.col("label"), per_class, "doc_id").select(F.col("doc_id").alias("id"), "label")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    found = found.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = found.select("label", "raw", F.xxhash64("doc_id", "raw").alias("order")).collect()
    return [(int(r["label"] > 0), bytes(r["raw"])) for r in sorted(rows, key=lambda r: (r["order"], r["raw"]))]


def identity(docs: DataFrame) -> Column:
    """Tells apart rows of one ``doc_id`` with different texts; rows equal in both share all results."""
    return F.xxhash64(F.col("text"))
