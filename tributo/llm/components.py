"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b); both long, in either order.

    Each round takes the least label among neighbours, then the label's own label, so paths are halved; the state is
    checkpointed, so that a lost executor costs one round. Ends when no label changes. Empty edges: an empty result.
    """
    links = edges.where("a <> b").select("a", "b")
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        # The own label comes in as one more thing heard, so one aggregation settles a round before the jump.
        heard = links.join(state.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), "component")
        own = state.select("node", F.col("component").alias("old"), "component")
        lower = heard.unionByName(own).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("component"))
        label = state.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(label, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        round_ = Observation()
        state = cut(jumped.observe(round_, F.count_if(F.col("old") != F.col("component")).alias("changed"))).select("node", "component")
        if not round_.get.get("changed"):
            return state


def joined(state: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component of all links so far: those that gave state, and edges (a, b) that came after.

    Only edges between two components count, and only components take part in the rounds, so what is settled isn't
    gone through again. Nodes of edges that state lacks are components of their own before.
    """
    named = lambda c: state.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    across = edges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(across.where("a <> b").distinct())
    merged = state.join(over.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    # A node that had no links before is its own component's name, so it stands in over.
    alone = over.join(state.select("component").distinct().withColumnRenamed("component", "node"), "node", "left_anti")
    return cut(merged.unionByName(alone.select("node", "component")))
