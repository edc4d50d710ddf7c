"""Seeded, reproducible sampling.

The order is that of ``sha256(seed + "\\n" + id)`` in lowercase hex, then the id. The hash
is materialised as a column, so the plan is one ``Project`` below ``TakeOrderedAndProject``:
each task keeps its own ``count`` smallest rows and only those travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest integer a double holds exactly; counts beyond it are refused.
MAX_SAFE_COUNT = 2**53 - 1


def sample_key(id_col: str, seed: str):
    """The sort key of a row: lowercase hex of SHA-256 over seed, newline, id."""
    return F.sha2(F.concat(F.lit(seed + "\n"), F.col(id_col).cast("string")), 256)


def check_sample_arguments(df: DataFrame, id_col: str, count: int, seed: str) -> None:
    """Refuse what ``limit`` would silently accept. One pass over the id column.

    Raises ValueError for a count that is not a safe non-negative integer or exceeds the
    number of rows, for an empty seed, and for null ids (a null key would sort first).
    """
    if isinstance(count, bool) or not isinstance(count, int) or not 0 <= count <= MAX_SAFE_COUNT or not seed:
        raise ValueError(f"a sample needs a seed and a count from 0 to {MAX_SAFE_COUNT}, not {count!r} and {seed!r}")
    rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} rows have no {id_col}")
    if count > rows:
        raise ValueError(f"a sample of {count} from {rows} rows")


def seeded_sample(df: DataFrame, id_col: str, count: int, seed: str, rank_col: str | None = None) -> DataFrame:
    """The first ``count`` rows in seeded order; the input's columns, and a 1-based rank if asked for.

    A sample of k is a prefix of a sample of k + 1, whatever the input order or
    partitioning. Rows of equal id are ordered by their remaining columns, so that repeated
    ids give one result too.
    """
    check_sample_arguments(df, id_col, count, seed)
    key = "__sample_key"
    rest = [F.col(f"`{c}`").cast("string") for c in df.columns if c != id_col]
    order = [key, F.col(id_col).cast("string"), *rest]
    out = df.withColumn(key, sample_key(id_col, seed)).orderBy(*order).limit(count)
    if rank_col:  # over the sample only
        out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    return out.drop(key)
