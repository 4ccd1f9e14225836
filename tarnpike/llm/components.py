"""Connected components of a table of edges, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import released, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names.

    ``edges`` has two columns a, b of one ordered type; direction, repeats and self-loops do not matter.
    Each round every node takes the smallest label among itself and its neighbours and then the label of
    that label, so a path of length d needs about log d rounds. Every round is written to the shared
    folder; groups are aggregated with partial sums, so one node with very many edges is no hot key. The result is a written table that the caller may release.
    """
    both = written(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the label of the label, from the round before: both sides of this join are shuffled, so that Spark splits the rows of a large component
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = jumped.where("label <> old").limit(1).count()
        released(before)
        before, labels = jumped, jumped.select("node", "label")
        if not changed:
            released(both)
            out = labels.withColumnRenamed("label", "component")
            out._tarnpike_path = jumped._tarnpike_path  # for ``released``
            return out
