"""Connected components of links, by smallest label, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import checkpointed


def components(links: DataFrame, n_links: int | None = None, max_rounds: int = 200) -> DataFrame:
    """``(node, label)`` for the nodes of ``links (a, b)``: the smallest node that links reach.

    Each round hooks every root to the smallest root across its links and then halves all
    paths, so the rounds grow with the logarithm of a component's diameter. Rounds end when
    no link joins two labels. Links are contracted as components merge; nodes with many
    links only take part in minima, which are summed before the shuffle. Every round is
    written to the shared folder.
    """
    edges = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), n_links)
    n = edges.count()
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = checkpointed(nodes.withColumn("label", F.col("node")), 2 * n)
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # each root's smallest neighbour; then that one's, so chains shorten
        hook = both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        jump = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.root"), "left").select("x.root", F.coalesce("y.to", "x.to").alias("to"))
        jump = checkpointed(jump.alias("x").join(jump.alias("y"), F.col("x.to") == F.col("y.root"), "left").select("x.root", F.coalesce("y.to", "x.to").alias("to")), 2 * n)
        labels = checkpointed(labels.join(jump, F.col("label") == F.col("root"), "left").select("node", F.coalesce("to", "label").alias("label")), 2 * n)
        for side in ("a", "b"):
            edges = edges.join(jump, F.col(side) == F.col("root"), "left").withColumn(side, F.coalesce("to", side)).select("a", "b")
        edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), n)
    raise RuntimeError("components did not settle")
