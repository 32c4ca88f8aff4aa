"""Connected components of links by passing on the smallest number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest number that links ``a, b`` reach from each number they name.

    Each round a number takes the smallest label around it, then the label of its label; the rounds end
    when nothing changes. Labels are written after each round. Minima are formed before the shuffle, so a
    number with very many links is no hot task.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        nearer = stored(nearer, "labels")
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(nearer.join(up, "label", "left").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
