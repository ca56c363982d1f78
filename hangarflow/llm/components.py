"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarflow.session import stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for the nodes of ``a``-``b`` edges.

    Each round points every node at the smallest node near it: first the larger
    neighbours of every node, then the smaller ones. A node's neighbours are
    only ever aggregated to a minimum, never listed. Rounds are written to the
    shared folder, so the lineage stays short; their number grows with the
    logarithm of the longest chain.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(),
        "components-links",
    )
    for _ in range(MOST_ROUNDS):
        both = links.union(links.select("low", "high")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
        # Larger neighbours of a node go to the node's minimum.
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low"))
        large = large.distinct()
        # A node and its smaller neighbours go to the smallest of them.
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(smallest, "high").select(F.explode(F.array("high", "low")).alias("high"), F.col("least").alias("low"))
        new = stored(small.where("high <> low").distinct(), "components-links")
        same = new.count() == links.count() and new.join(links, ["high", "low"], "left_anti").isEmpty()
        links = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.union(links.select("low", "low")).distinct()
