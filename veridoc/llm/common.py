"""Shared plumbing: appended columns, shared folders, vocabularies."""

from __future__ import annotations

import base64
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veridoc.llm import vec


def ddl(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


# -- what a worker process keeps ------------------------------------------------------------

_kept: list = []
_owner: list[str] = [""]


def kept(make: Callable) -> Callable:
    """A value by its arguments, made once and kept in the worker as long as it serves one operator."""
    out = cache(make)
    _kept.append(out)
    return out


def released() -> None:
    """Give memory that is free back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def entered(owner: str) -> None:
    """Called as an operator begins work in a process: what other operators have kept there goes, so that a worker never holds more than one operator's tables."""
    if _owner[0] != owner:
        _owner[0] = owner
        for x in _kept:
            x.cache_clear()
        gc.collect()
        released()


def with_columns(df: DataFrame, column: str, fields: str, make: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """Append columns that are computed from one string column, batch by batch, without a shuffle.

    ``make()`` runs once per task and returns a function from the column's Arrow array to
    the new arrays. A column of the input named like a new one, in any case, is replaced.
    """
    added = ddl(fields)
    taken = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    # Python stages don't take columns of any name, so they are numbered there
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    arrow = to_arrow_schema(numbered)
    given = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), *([] if column in kept else [F.col(f"`{column}`").alias("given")]))
    read = f"c{kept.index(column)}" if column in kept else "given"

    def run(batches):
        entered(fields)
        fn = make()
        for b in vec.slices(batches, read):
            new = fn(b.column(read))
            old = [b.column(f"c{i}") for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip([*old, *new], arrow)], schema=arrow)
        released()

    return given.mapInArrow(run, numbered).toDF(*schema.names)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors and the driver can read and write: below spark.checkpoint.dir, or the folder given to ``SparkContext.setCheckpointDir``.

    Where neither is set, a session in one process has a temporary folder of its machine, and
    any other raises ValueError: no folder of one machine would do. The folder goes when the
    application ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and re.fullmatch(r"local(\[.*\])?", context.master):
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='veridoc-')}")
        base = context.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration()).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a small table in a file, and of one that takes work to make.
ROWS_A_FILE, ROWS_A_TASK = 200_000, 2_500


@contextmanager
def _cleaned(spark: SparkSession):
    """For an action within: its shuffle files go when it ends, not when the driver collects its garbage; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame, rows: int | None = None, each: int = ROWS_A_FILE) -> DataFrame:
    """The same rows without lineage, kept in the shared folder as Parquet; survives lost executors.

    ``rows`` is a bound of the number of rows, if one is known: a small table goes to few files.
    """
    path = shared_folder(df.sparkSession, "cut")
    with _cleaned(df.sparkSession):
        (df if rows is None else df.coalesce(max(1, -(-rows // each)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """As :func:`checkpointed`, in n buckets of a column: joins by it bring the other side to these rows, which don't move.

    The rows should come in n partitions of that column. The table is in the catalog only while it is made.
    """
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.format("parquet").option("path", shared_folder(spark, "cut")).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the folder stays
    return out


def forget(df: DataFrame) -> None:
    """Remove the folder of a table that :func:`checkpointed` or :func:`bucketed` made, and that nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        dropped(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more rows than this, and more than this part of all, is looked up in a broadcast; there are at most so many such keys.
HOT_ROWS, HOT_KEYS = 256, 20_000


def skew_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join by one column, of which the right side has each value once and the left side may have any number of rows.

    Values that hold more than one in HOT_KEYS of the left rows can't be more than HOT_KEYS;
    their rows don't move, the others are joined by a shuffle.
    """
    total = left.count()
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter((F.col("n_rows") > HOT_ROWS) & (F.col("n_rows") > total // HOT_KEYS)).select(key)
    found = counts.collect()  # HOT_KEYS at most
    if not found:
        return left.join(right, key, "left")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, counts.schema))
    some = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return some.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def planned_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of the input's size, None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Enough partitions that each holds about that much of the input as planned, and no fewer than the session's."""
    size = planned_bytes(df) or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """For an action within: texts go to Python workers in batches of so many rows at most; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# -- vocabularies -----------------------------------------------------------------------------


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@kept
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@kept
def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token by id."""
    r = ranks(path)
    out = np.zeros(max(r.values()) + 1, np.int64)
    out[list(r.values())] = list(map(len, r))
    return out


@kept
def bpe(path: str):
    """The public byte-level BPE for ranks in a file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@kept
def bpe_cache(path: str) -> vec.PieceCache:
    """Token ids of pieces; one per worker process."""
    core = bpe(path)._core_bpe

    def compute(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [core.encode_single_piece(p) for p in found]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    return vec.PieceCache(compute, np.uint32)
