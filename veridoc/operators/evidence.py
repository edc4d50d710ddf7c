"""Reconciliation and accounting rules: nothing leaves the denominator, nothing is substituted silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Per group: all rows, rows that are ok, held rows (false or null). One unfiltered aggregate with partial sums."""
    flag = F.coalesce(ok, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(flag).alias("n_ok"), F.count_if(~flag).alias("n_held"))


def hash_reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per distinct key of either side: ``both``, ``only_left`` or ``only_right``, with the count on each side.

    Both sides are aggregated before they meet, so a key that holds a third of the rows
    crosses the network once per map task. Null keys are one key.
    """
    sides = [df.select(key).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "n_left"), (right, "n_right"))]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    n_left, n_right = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        F.when(n_right == 0, "only_left").when(n_left == 0, "only_right").otherwise("both").alias("side"),
        n_left.alias("n_left"),
        n_right.alias("n_right"),
    )


def identity_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def with_provenance(df: DataFrame, verified: str, calculated: str) -> DataFrame:
    """Say which value a row has; the two columns stay apart and are never coalesced."""
    return df.withColumn(
        "provenance",
        F.when(F.col(verified).isNotNull(), "verified").when(F.col(calculated).isNotNull(), "calculated_only").otherwise("none"),
    )


def reconciled_only(df: DataFrame, reconciled: Column) -> DataFrame:
    """The rows that hold an independent reconciliation, which the caller states; false and null are held back, and count in :func:`coverage`."""
    return df.filter(F.coalesce(reconciled, F.lit(False)))
