"""Connected components by label propagation with shortcuts, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of the label, so that long chains shrink by
    powers of two. Rounds end when nothing changes; every round's labels are written to shared storage.
    """
    both = stored(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links"
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")),
        "labels",
    )
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("root").alias("_near"))
        near = both.join(of, "other").groupBy("node").agg(F.min("_near").alias("_near"))
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("root").alias("_old"), F.least("root", "_near").alias("root")
        )
        step = labels.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        new = stored(
            hooked.join(step, "root", "left").select("node", "_old", F.least("root", "_next").alias("root")), "labels"
        )
        labels = new.select("node", "root")
        if new.where("root <> _old").isEmpty():
            return labels
