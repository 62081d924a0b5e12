"""Connected components of a table of links, by minimum labels and pointer jumping.

Each pass is two aggregations and joins over tables that are written to the shared folder, so neither links
nor labels come to the driver; a node with many links is pre-aggregated like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabiya.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of links (a, b), which should be a table."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).filter("u != v")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        # The smallest label among a node, its neighbours and its label's own label.
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        root = labels.select("node", F.col("label").alias("at")).join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", "label")
        least = near.union(root).groupBy("node").agg(F.min("label").alias("to"))
        # Labels hook too: whoever carries a label learns what another carrier of it has found.
        hooked = labels.join(least, "node").select("label", "to").groupBy(F.col("label").alias("node")).agg(F.min("to").alias("to"))
        after = cut(least.union(hooked).groupBy("node").agg(F.min("to").alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").filter("label != was").limit(1).count()
        labels = after
        if not changed:
            return labels
