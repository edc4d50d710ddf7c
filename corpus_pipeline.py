"""A corpus pipeline: rules, near duplicates, secrets, mixture, tokens; each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the
columns of ``documents``; the last returns the tokens of each text. ``run`` writes each
stage's rows as Parquet to the shared folder and reads them back for the next; then its predecessor's go.

Null and empty texts are rejected by the first stage. Rows that repeat an id are rows of
their own everywhere. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import bpe, jaccard, mixing, quality, secrets
from veridoc.llm.common import dropped, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the bands of their language."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (five words, similarity 0.8 or more).

    Rows that share that id are told apart by their text: the smallest one stays.
    """
    return jaccard.one_of_each(docs, words=5, threshold="4/5")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced by their kind; ``n_chars`` follows the text."""
    out = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and digest of what they decode to."""
    return bpe.digest(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Fertility, checksums and merges can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
