"""Connected components of links, by label propagation with pointer jumping.

Every round writes its labels to the shared folder, so lineage stays short and a lost executor
costs one round. Joins read both sides from tables, where Spark splits the partitions of a vertex
with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of a link ``a, b``: the smallest id it can reach."""
    both = links.select("a", "b").filter("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    total = lambda df: df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    last = total(labels)
    while last is not None:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("component"))
        roots = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        labels = stored(hooked.join(roots, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        now = total(labels)
        if now == last:
            break
        last = now
    return labels
