"""Connected components over an edge list, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the id is the smallest node.

    Each round joins every node with the smallest label of its neighbours and
    then follows that label's own label (pointer jumping), so that the number
    of rounds grows with the logarithm of the diameter. Every round is written
    to the shared folder. Null ends and loops are ignored; no edges give an
    empty result. Raises if ``max_rounds`` is not enough, never cuts short.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(e.union(e.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = materialize(labels, "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("far"))
        new = materialize(step.join(jump, "m", "left").select("node", "old", F.least("m", "far").alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
