"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected(links: DataFrame) -> DataFrame:
    """(node, label): for every node of ``links`` (a, b) the smallest node that is reachable.

    Labels spread to neighbours and then jump to their label's label, so chains shorten by half each round.  Each round is
    written to the checkpoint folder; the driver only sees whether a label has changed.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = durable(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = durable(spread.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
