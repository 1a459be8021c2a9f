"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links; the root is the smallest node reachable.

    Rounds of "take the smallest label among the neighbours, then jump to the label's own label" until nothing changes. Every round
    is a few shuffles of nodes and links, and is written out; hot nodes are pre-aggregated before the shuffle.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("low"))
                   .select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low")))
        lower = (labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "low").alias("mid")))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = stage(lower.join(jump, "mid").select("node", "was", F.least("mid", "far").alias("root")), "labels")
        changed = after.where("was <> root").limit(1).count()
        labels = after.drop("was")
        if not changed:
            return labels
