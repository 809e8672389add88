"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.session import checkpointed, hot_keys, salted_join


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(id, component)``: for every id in a link the smallest id that can be reached.

    Labels move to neighbours and then along the labels' own labels, so the number of rounds is about the logarithm
    of the longest path.  Every round is checkpointed; nothing but a count reaches the driver.  The links of a hub, an
    id with very many, are dealt to several tasks.  Repeated links,
    links in either direction and links of an id to itself are allowed; null ends are ignored.  No links: no rows.
    """
    links = links.where("a is not null and b is not null")
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    hot = hot_keys(edges, "b")
    labels = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = salted_join(edges, labels.withColumnRenamed("id", "b"), "b", hot).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = checkpointed(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        of = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels_next = checkpointed(salted_join(moved, of, "component", hot_keys(moved, "component")).select("id", "old", F.least("component", "further").alias("component")))
        changed = labels_next.where("component <> old").limit(1).count()
        labels = labels_next.select("id", "component")
        if not changed:
            return labels
