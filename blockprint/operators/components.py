"""Connected components of a graph of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprint.plans.checkpoints import cut


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (a, b): root is the least node of its component.

    Each round a node takes the least label around it and then that label's own label, so paths shrink by more than half.
    Sums over a node's links are partial first and joins may be split by Spark, so a node with very many links is no
    matter. Every round is written to the shared folder; the driver sees one number of it.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_node")).agg(F.min("root").alias("_least"))
        nearer = labels.join(around, F.col("node") == F.col("_node")).select("node", F.col("root").alias("_was"), F.least("root", "_least").alias("root"))
        up = labels.select(F.col("node").alias("_of"), F.col("root").alias("_up"))
        new = cut(nearer.join(up, F.col("root") == F.col("_of")).select("node", F.least("root", "_up").alias("root"), "_was"))
        labels = new.select("node", "root")
        if new.where("root <> _was").isEmpty():
            return labels
