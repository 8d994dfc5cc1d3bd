"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import stage_table

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then the label of
    that label, so the rounds grow with the logarithm of the longest path. Only
    the number of changed labels reaches the driver. An empty table gives one.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage_table(both.where("a <> b").distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = stage_table(lower, "labels-near")
        # Labels that point further: one row for each, however many nodes bear it, so that Spark broadcasts them while they are few.
        named = lower.select("component").distinct()
        further = lower.where("component < id").join(named.withColumnRenamed("component", "id"), "id", "left_semi").select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = lower.join(further, "component", "left").select("id", "old", F.coalesce("further", "component").alias("component"))
        labels = stage_table(new, "labels")
        if not labels.where("component < old").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError("labels still change")
