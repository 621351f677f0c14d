"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpframe.llm.common import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge: comp is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the
    label of that label (pointer jumping); labels are written between rounds
    so no round's lineage holds another's. Rounds stop when nothing changes.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")) \
        .union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v")
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "comp"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("m")))
        better = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        roots = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = written(better.join(roots, "comp", "left")
                      .select("node", F.least("comp", F.coalesce("root", "comp")).alias("comp"), "old"), "labels")
        changed = new.where("comp <> old").limit(1).count()
        drop_written(labels)
        labels = new.select("node", "comp")
        if not changed:
            drop_written(both)
            return labels
