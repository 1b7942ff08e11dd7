"""Connected components of an edge table by least labels and pointer jumping; nothing is gathered to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b: long): component is the smallest node reachable.

    Repeated edges, both directions and loops are allowed; an empty table gives an empty result. Each round joins
    labels along the edges, takes minima (combined before the shuffle) and replaces each label by its label's label,
    so rounds grow with the logarithm of a component's diameter. Large stars are joined by adaptive skew joins, and
    each round's labels are written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL")
    both = stored(both.distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = lower.join(jump, "label").select("node", "was", F.least("label", "next").alias("label"))
        found = stored(after, "labels")
        dropped(labels)
        labels = found.select("node", "label")
        if found.filter("was <> label").isEmpty():
            dropped(both)
            return labels.withColumnRenamed("label", "component")
