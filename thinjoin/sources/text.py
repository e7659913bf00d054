"""Delimited text: scans with a declared schema, rows that do not fit it, and conversion to Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the known text tables. Readers take STRING where a table definition says VARCHAR(n).
SCHEMAS = {
    "synthetic": "col1 BIGINT, col2 INT, col3 INT, col4 STRING",
    "orders": "order_id INT, user_id INT, eval_set STRING, order_number INT, order_dow INT, "
    "order_hour_of_day INT, days_since_prior DECIMAL(5,1)",
    "order_products": "order_id INT, product_id INT, add_to_cart_order INT, reordered INT",
    "products": "product_id INT, product_name STRING, aisle_id INT, department_id INT",
    "aisles": "aisle_id INT, aisle STRING",
    "departments": "department_id INT, department STRING",
}


#: Column of the raw lines that do not fit a schema.
BROKEN = "_broken"


def scan_text(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def scan_checked(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", header: bool = False) -> DataFrame:
    """The scan with ``BROKEN``: the raw line of a row with too few or too many fields, or a value of another type.

    Without it such rows would come as NULLs that nobody sees. A row fits as a whole or not at all, whatever columns a
    query uses. Lines that are empty, and with ``header`` those that name the columns, are left out.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {BROKEN} STRING"
    lines = spark.read.text(path)
    if header:
        lines = lines.where(F.col("value") != sep.join(fields.names))
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    return lines.where(F.col("value") != "").select(F.from_csv("value", ddl, options).alias("row")).select("row.*")


def fitting_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_lines(checked: DataFrame) -> DataFrame:
    """(line) of the rows that do not fit."""
    return checked.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def checked_text_to_parquet(
    spark: SparkSession, source: str, target: str, broken: str, schema: str | T.StructType, sep: str = "|"
) -> tuple[DataFrame, int]:
    """Rewrite the rows that fit as Parquet and the others as text under ``broken``; the table and the number of the others."""
    checked = scan_checked(spark, source, schema, sep)
    fitting_rows(checked).write.mode("overwrite").parquet(target)
    broken_lines(checked).write.mode("overwrite").text(broken)
    return spark.read.parquet(target), spark.read.text(broken).count()


def scan_leading_columns(spark: SparkSession, path: str, types: Sequence[str], sep: str = "|") -> DataFrame:
    """The first columns of headerless text, named ``col1``, ``col2``, ..."""
    schema = ", ".join(f"col{i} {t}" for i, t in enumerate(types, start=1))
    return scan_text(spark, path, schema, sep)


def text_to_parquet(spark: SparkSession, source: str, target: str, schema: str | T.StructType, sep: str = "|") -> DataFrame:
    """Rewrite a text table as Parquet and return the Parquet table."""
    scan_text(spark, source, schema, sep).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_text(df: DataFrame, path: str, sep: str = "|") -> None:
    df.select([F.col(c) for c in df.columns]).write.mode("overwrite").option("sep", sep).csv(path)
