"""Connected components of an undirected graph given as edges, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, label): label is the smallest node that can be reached.

    Each round a node takes the smallest label of its neighbours, then the label of its label; the
    hook through each node's old label makes long chains collapse in a logarithmic number of rounds.
    Minima are combined before each shuffle, so a node with a third of all edges stays cheap. Labels
    stay distributed; the driver sees one count a round. No edges give an empty result.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("near"))
        # What a node learns also goes to its old label, which may be far from it.
        hook = step.filter("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("up"))
        step = step.join(hook, "node", "left").select("node", "label", F.least("near", "up").alias("near"))
        step = materialise(step, "step")
        jump = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = materialise(step.join(jump, "near").select("node", F.least("near", "far").alias("label"), F.expr("least(near, far) < label").alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        forget(labels, step)
        labels = new.select("node", "label")
        labels._landloom_path = new._landloom_path
        if not moved:
            forget(both)
            return labels
    raise RuntimeError("components did not settle")
