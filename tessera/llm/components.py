"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.checkpoints import cut


def least_members(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id that can be reached.

    Each round takes the least label among neighbours and then the label's own label,
    so chains shorten by more than half. Labels only meet links in joins whose link side
    may be split where an id has very many, and are kept in the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), narrow=True)
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), narrow=True)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = cut(lower.join(own, "component").select("id", "old", F.least("component", "further").alias("component")), narrow=True)
        moved = labels.where(F.col("component") < F.col("old")).limit(1).count()
        labels = labels.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError("labels still change")
