"""Registers of quotes in CSV or JSON files, gzipped or not, and where results may be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_register(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A register with the schema given: CSV with a header, or a JSON object per line (or one array); ``.gz`` is read by its name.

    A row that doesn't fit the schema fails the query; nothing is dropped or guessed.
    """
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.schema(schema).json(path, mode="FAILFAST", multiLine=kind == "json")
    raise ValueError(f"neither CSV nor JSON: {path}")


def check_output(inputs: list[str], output: str) -> None:
    """Refuse an output that lies in an input, is one, or holds one: sources are only read."""
    parts = lambda p: [x for x in p.split("/") if x not in ("", ".")]
    out = parts(output)
    for path in inputs:
        n = min(len(out), len(parts(path)))
        if out[:n] == parts(path)[:n]:
            raise ValueError(f"{output} would change the source {path}")
