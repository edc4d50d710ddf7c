"""Type declarations to Spark schemas and checks; closed value domains.

A declaration maps field names to ``String``, ``String[]``, a list of values (closed
enumeration) or ``package::name*`` (a reference, kept as link text); ``?`` after the name
makes the field optional. Columns that a type doesn't declare are tolerated.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(name: str, declared) -> T.StructField:
    optional, name = name.endswith("?"), name.removesuffix("?")
    meta = {}
    if isinstance(declared, list):
        kind, meta = T.StringType(), {"enum": [str(x) for x in declared]}
    elif declared == "String":
        kind = T.StringType()
    elif declared == "String[]":
        kind = T.ArrayType(T.StringType(), False)
    elif isinstance(declared, str) and declared.endswith("*") and "::" in declared:
        kind, meta = T.StringType(), {"reference": declared.removesuffix("*")}
    else:
        raise ValueError(f"unknown type of field {name}: {declared!r}")
    return T.StructField(name, kind, optional, meta)


def schema_of(declaration: dict, parents: dict[str, T.StructType] | None = None, comments: dict[str, str] | None = None) -> T.StructType:
    """The schema of a type; a known parent's fields come first, an unknown parent adds none.

    ``comments`` by field name go to the fields' metadata, where Spark keeps a column's comment.
    """
    base = (parents or {}).get(declaration.get("extends", ""), T.StructType())
    own = [field(k, v) for k, v in (declaration.get("fields") or {}).items()]
    for f in own:
        if f.name in (comments or {}):
            f.metadata["comment"] = comments[f.name]
    names = {f.name for f in own}
    return T.StructType([f for f in base.fields if f.name not in names] + own)


def violations(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """Rows ``(key, field, problem)``: ``missing`` for required fields, ``outside_domain`` for enumerations. One pass."""
    checks: list[Column] = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        problem = F.when(value.isNull(), F.lit(None if f.nullable else "missing"))
        if "enum" in f.metadata:
            problem = problem.when(~value.isin(f.metadata["enum"]), "outside_domain")
        else:
            problem = problem.otherwise(F.lit(None))
        checks.append(F.struct(F.lit(f.name).alias("field"), problem.cast("string").alias("problem")))
    if not checks:
        return df.select(key, F.lit("").alias("field"), F.lit("").alias("problem")).limit(0)
    return df.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.field", "c.problem").filter("problem IS NOT NULL")


#: Words of a column's name that claim how a quote ended.
OUTCOMES = frozenset("win wins won loss losses lost outcome".split())


def check_no_outcome(schema: T.StructType) -> None:
    """Refuse a column that claims an outcome: a posted status is no verified win or loss."""
    for f in schema.fields:
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", f.name).lower()))
        if words & OUTCOMES:
            raise ValueError(f"column {f.name} claims an outcome")


def check_apart(schema: T.StructType, hint: str, basis: str) -> None:
    """Refuse a table without both columns: a classification is a hint and stays beside what it rests on."""
    missing = [c for c in (hint, basis) if c.lower() not in {f.name.lower() for f in schema.fields}]
    if missing or hint.lower() == basis.lower():
        raise ValueError(f"a hint needs its basis beside it: {hint}, {basis}")


def domain(spark: SparkSession, values: dict[str, list[str]]) -> DataFrame:
    """Every combination of closed selectors. Literals only; no table is crossed."""
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), values.items(), spark.range(1).drop("id"))


def in_domain(values: dict[str, list[str]]) -> Column:
    """True where every selector holds one of its values."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(k).isin(v), F.lit(False)) for k, v in values.items()))
