"""Connected components of an edge table, by hooking and contraction. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_written

#: Hooks that a round follows from a node.
WAY = 4


def further(t: DataFrame, labels: DataFrame) -> DataFrame:
    """t(node, label) with each label's own label in its place."""
    up = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
    return t.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("further", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(a, b), component being its smallest reachable node.

    Each round hooks every node to that of its neighbours and itself which a hash ranks first, follows WAY hooks (ranks are at random along
    a path, so that few nodes are further from their root; such stay for the next round), and puts the labels so found in the place of the
    edges' ends. Edges within a label go, so that each round reads only what is left; the number of rounds goes with the logarithm of the
    longest path. Joins are plain equi-joins that Spark may split where a label has very many nodes. Each round is written to the shared
    folder.
    """
    edges = edges.select("a", "b").where("a <> b")
    left = cut(edges.union(edges.select("b", "a")).distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        own, other = (F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("label")) for c in "ab")
        hooks = cut(left.groupBy("a").agg(F.min(other).alias("best")).select(F.col("a").alias("node"), F.least("best", own)["label"].alias("label")), "hooks")
        labels = cut(reduce(further, [hooks] * WAY), "labels")
        of_a, of_b = (labels.select(F.col("node").alias(f"node_{s}"), F.col("label").alias(f"label_{s}")) for s in "ab")
        ends = left.join(of_a, F.col("a") == F.col("node_a")).select("label_a", "b").join(of_b, F.col("b") == F.col("node_b"))
        old, left = left, cut(ends.where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "edges")
        drop_written(old)
        drop_written(hooks)
        rounds.append(labels)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = cut(reduce(further, rounds), "labels")
    least = named.groupBy(F.col("label").alias("of")).agg(F.min("node").alias("component"))
    out = cut(named.join(least, F.col("label") == F.col("of")).select("node", "component"), "components")
    for done in (*rounds, named, left):
        drop_written(done)
    return out
