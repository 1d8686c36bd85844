"""Connected components by min-label propagation with pointer jumping, over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (v, label): the smallest id of v's component.  Only linked ids occur.

    Each round takes the least label of the neighbours, then the label of that label, so
    long chains halve.  Every round is written to the shared folder.
    """
    both = staged(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label"))
    labels = staged(labels, "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["v"] == near["a"], "left").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        at = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
        new = new.join(at, new["label"] == at["_v"], "left").select("v", F.least("label", "_label").alias("label"), "old")
        new = staged(new, "labels")
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
