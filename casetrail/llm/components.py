"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) of every end of an edge (``a``, ``b``); a component is its smallest id.

    Each round lowers every node's label to the least of its neighbours' labels and then to that
    label's own label, until no label changes. Labels stay in tables; only counts
    reach the driver. Nulls are not allowed; loops and repeated edges do no harm.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        named = labels.select(F.col("id").alias("a"), "component")
        offered = both.join(named, "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("offer"))
        lowered = labels.join(offered, "id").select("id", F.least("component", "offer").alias("next"), "component")
        jumps = lowered.select(F.col("id").alias("next"), F.col("next").alias("jump"))
        moved = cut(lowered.join(jumps, "next").select("id", F.least("next", "jump").alias("next"), "component"))
        changes = moved.where("next < component").count()
        labels = moved.select("id", F.col("next").alias("component"))
        if not changes:
            return labels


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after further edges; only components that an edge joins are looked at again."""

    def ends(name: str) -> DataFrame:
        return labels.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))

    between = (
        edges.join(ends("a"), "a", "left")
        .join(ends("b"), "b", "left")
        .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        .where("a <> b")
    )
    merged = connected_components(between)
    renamed = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("final")), "component", "left")
    kept = renamed.select("id", F.coalesce("final", "component").alias("component"))
    return cut(kept.unionByName(merged.join(labels, "id", "left_anti")))
