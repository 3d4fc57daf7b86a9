"""Connected components of a link table, by joins only."""

from pyspark.sql import DataFrame, functions as F

from hostweave.llm.common import staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every end of ``links`` (a, b): the smallest node reached.

    Every round takes the smallest label among the neighbours and then follows
    labels of labels, so the number of rounds grows with the logarithm of the
    longest chain. Labels are staged every round and nothing is collected but
    the number of changes. Null ends, loops and repeated links are allowed.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = staged(
        ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), f"{name}-links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("component")), name)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "reached"}), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("reached").alias("reached"))
        step = labels.join(least, "node", "left").select(
            "node", F.col("component").alias("old"),
            F.least("component", "reached").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = staged(step.join(far, "mid", "left").select(
            "node", "old", F.least("mid", "far").alias("component")), name)
        labels = step.select("node", "component")
        if step.where(F.col("old") != F.col("component")).isEmpty():
            return labels
