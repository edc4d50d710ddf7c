"""Directed links ``[[target]]`` and ``[[target::package]]``: extraction, resolution, bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r"\[\[([^\[\]]+?)\]\]"


def extract_links(df: DataFrame, src: str, field: str) -> DataFrame:
    """Edges ``(src, field, target, package)``, one per link in that column; package is null if not given."""
    found = df.select(F.col(src).alias("src"), F.explode(F.regexp_extract_all(F.col(field), F.lit(LINK), F.lit(1))).alias("link"))
    parts = F.split("link", "::", 2)
    return found.select("src", F.lit(field).alias("field"), F.trim(parts[0]).alias("target"), F.trim(F.get(parts, F.lit(1))).alias("package"))


def dangling_links(edges: DataFrame, target: str, nodes: DataFrame, node: str) -> DataFrame:
    """Edges whose target is no node. A null target names nothing, so it doesn't dangle; null nodes are none."""
    return edges.filter(F.col(target).isNotNull()).join(nodes.select(F.col(node).alias("__node")).distinct(), F.col(target) == F.col("__node"), "left_anti")


def follow(edges: DataFrame, start: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """Nodes within ``depth`` links of ``start`` (column ``node``), with the smallest number of links. Null nodes and targets lead nowhere.

    A level joins the nodes that are new with the edges and leaves out those seen before, so each
    node is expanded once; the depth bounds the plan.
    """
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(kinds))
    steps = edges.select("src", "target").filter("target IS NOT NULL")
    frontier = start.select("node").filter("node IS NOT NULL").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("target").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen


def allowed(requests: DataFrame, name: str, profiles: DataFrame, profile: str) -> DataFrame:
    """Requests whose tool is in the list of their profile (``profile``, ``tools array<string>``); an empty list allows nothing."""
    listed = profiles.select(F.col(profile).alias("__p"), F.explode("tools").alias("__t"))
    return requests.join(listed, (F.col(profile) == F.col("__p")) & (F.col(name) == F.col("__t")), "left_semi")
