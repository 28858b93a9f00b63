"""Connected components of a link table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); only nodes that have links.

    Every round each node takes the smallest label around it and then that label's own label (pointer
    jumping), so long chains shrink by halves. Labels are minima, counted before the shuffle, so a node
    with very many links costs one row a task.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        near = labels.join(seen, "node").select("node", F.least("component", "m").alias("near"), F.col("component").alias("old"))
        far = labels.select(F.col("node").alias("n2"), F.col("component").alias("far"))
        new = materialise(near.join(far, F.col("near") == F.col("n2")).select("node", F.least("near", "far").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
