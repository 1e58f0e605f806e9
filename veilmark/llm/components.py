"""Connected components of a graph whose links and labels stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, settled


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for the nodes of ``links`` (a, b): comp is the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours, then
    follows the label of the label, so chains shrink by a power; rounds end when
    no label changes.  Rows are two numbers, sums before shuffles keep a hub's
    rows few, and adaptive execution splits the join by a hub.  What a round
    leaves is written to the shared folder.
    """
    with scratch(links.sparkSession) as keep:
        links = links.where("a <> b")
        both = settled(links.select("a", "b").union(links.select("b", "a")).distinct())
        labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"))
        labels = settled(labels)
        while True:
            near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
            lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
            of = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
            new = lower.join(of, F.col("low") == F.col("n2")).select("node", F.least("low", "c2").alias("comp"), (F.least("low", "c2") != F.col("was")).alias("changed"))
            new = settled(new)
            if new.where("changed").isEmpty():
                return keep(new.select("node", "comp"))
            labels = new.select("node", "comp")
