"""Connected components by joins: smallest label spreading, with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.sources.tables import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the least node of each connected component.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so long chains shrink by halves, until a round changes
    nothing. Rounds are written to the shared folder. Null ends and loops are left out; repeated edges make no
    difference; no edges give no rows.
    """
    clean = edges.where("a is not null and b is not null and a != b").select("a", "b")
    both = cut(clean.unionByName(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"))
    while True:  # every round lowers a label or is the last
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(near, "node", "left").select("node", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = step.select(F.col("node").alias("k"), F.col("l").alias("further"))
        new = cut(step.join(jump, F.col("l") == F.col("k"), "left").select("node", "was", F.least("l", F.coalesce("further", "l")).alias("l")))
        labels = new.select("node", "l")
        if new.where("was != l").limit(1).count() == 0:
            return labels.select("node", F.col("l").alias("component"))
