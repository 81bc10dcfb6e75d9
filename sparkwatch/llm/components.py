"""Connected components of a link table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwatch.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes in ``a, b``: the smallest node that links lead to.

    Each round takes the smallest label of the neighbours and then the label of that label, so a chain of n nodes takes a number of
    rounds logarithmic in n. Sums and minima per node are formed before rows are shuffled, so a node with very many links
    is no hot spot. Rows with a missing end are left out.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    flipped = known.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = stored(known.select("a", "b").unionByName(flipped).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_near"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "_near").alias("_low"))
        target = lower.select(F.col("node").alias("_low"), F.col("_low").alias("_jump"))
        moved = stored(lower.join(target, "_low").select("node", F.col("_jump").alias("root"), (F.col("_jump") != F.col("root")).alias("_moved")))
        labels = moved.select("node", "root")
        if not moved.where("_moved").head(1):
            return labels
