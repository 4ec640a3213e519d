"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.storage import lasting, scope, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node that edges lead to, in either direction.

    Every round gives each node the smallest label among its neighbours, then
    the label of its label. The labels are written to the shared folder each
    round, which also lets a node with very many edges be split by adaptive
    execution; they are removed when the result is written. Self-loops, repeated edges and edges with a null end are
    ignored; a node without another end is in no result row.
    """
    with scope():
        plain = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
        both = stored(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        while True:
            with scope():
                seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
                best = stored(labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
                up = best.select(F.col("node").alias("label"), F.col("label").alias("up"))
                jumped = lasting(best.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
            labels = jumped.select("node", "label")
            if jumped.where("label <> old").isEmpty():
                return lasting(labels.select("node", F.col("label").alias("component")))
