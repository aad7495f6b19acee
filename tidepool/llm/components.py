"""Connected components by smallest label, with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, label, and more) of every node of edges (a, b): label is the smallest node that it is connected with.

    In each round a node takes the smallest label among its neighbours' and its own, then that label's own label; the work of a round is
    in proportion to the edges, whatever their degrees (minima are formed before rows move, and joins have a unique side).
    """
    both = materialise(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))), "links")
    labels = materialise(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("label")).withColumn("was", F.col("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        less = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        own = labels.select(F.col("v").alias("via"), F.col("label").alias("top"))
        step = materialise(less.join(own, "via").select("v", F.least("via", "top").alias("label"), "was"), "labels")
        discard(labels)
        labels = step
        if labels.where("label != was").isEmpty():
            discard(both)
            return labels
