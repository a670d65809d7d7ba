"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _renamed(edges: DataFrame, to: DataFrame) -> DataFrame:
    """The edges between the nodes' parents, each once, without loops."""
    a = to.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    b = to.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    both = edges.join(a, "a").join(b, "b").where("pa <> pb")
    return both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node of its component, for every node of an edge.

    Rounds of contraction: every node takes its smallest neighbour as parent if that is
    smaller, parents are followed to the end, and the edges are renamed to these. All nodes but
    local minima vanish in a round, so the graph shrinks to half or less each time. Labels
    and edges stay in tables; only whether edges are left comes to the driver.
    """
    edges = checkpointed(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    labels = None
    while edges.limit(1).count():
        low = edges.select(F.col("b").alias("node"), F.col("a").alias("parent")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("parent")))
        to = checkpointed(low.groupBy("node").agg(F.min("parent").alias("parent")))
        # Parents are smaller, so following them ends; each step doubles the reach.
        while True:
            further = to.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            new = checkpointed(to.join(further, "parent").select("node", F.col("up").alias("parent"), (F.col("up") < F.col("parent")).alias("moved")))
            to = new.select("node", "parent")
            if not new.where("moved").limit(1).count():
                break
        if labels is None:
            labels = to.withColumnRenamed("parent", "label")
        else:
            moved = to.select(F.col("node").alias("label"), F.col("parent").alias("new"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        labels = checkpointed(labels)
        edges = checkpointed(_renamed(edges, to))
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
