"""Connected components of a link table, by the smallest label among neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of a link and the smallest node that it reaches. Links go both ways; nulls and repeated links add nothing.

    Each round takes the least label around a node, then the label of that label, so a chain of n nodes takes about log2 n rounds. A hub's
    links are summed before they are shuffled, and a hot side of a join can be split: the other side has one row per node."""
    one = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    both = settle(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = settle(nearer.join(root, "label").select("node", "old", F.least("label", "far").alias("label")))
        moved = jumped.where("label != old").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
