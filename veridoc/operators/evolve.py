"""Idempotent schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def add_column_if_absent(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A null column of that type, unless one of that name exists, whatever its type or case."""
    if name.lower() in (c.lower() for c in df.columns):
        return df
    return df.withColumn(name, F.lit(None).cast(kind))


def add_table_column_if_absent(spark: SparkSession, table: str, name: str, kind: str) -> bool:
    """The same for a catalog table; True if the column was added. A missing table is an error."""
    if name.lower() in (c.name.lower() for c in spark.table(table).schema):
        return False
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS (`{name}` {kind})")
    return True
