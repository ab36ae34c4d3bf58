"""Connected components of an edge table: smallest label by propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .native import heavy_keys, spread_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest reachable node), for every node of edges (a, b: long).

    Each round is one written table, so lineage stays short; only a change count comes to the driver. Every
    round hooks a node to the smallest label around it, then halves the way to that label's own label. A node
    with very many neighbours and a label of very many nodes are dealt to parts in the joins.
    """
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = scratch.table(heavy_keys(both, ["b"]), "hubs")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels0")
    round_ = 0
    while True:
        round_ += 1
        near = spread_join(both, labels.select(F.col("node").alias("b"), F.col("component").alias("c")), ["b"], "a", hubs).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        # a node tells its label's node what it has seen, so that whole trees move
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = scratch.table(step, f"step{round_}")
        told = step.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("told"))
        hooked = step.join(told, "node", "left").select("node", "old", F.least("new", F.coalesce("told", "new")).alias("new"))
        hooked = scratch.table(hooked, f"hooked{round_}")
        top = hooked.select(F.col("node").alias("new"), F.col("new").alias("top"))
        large = scratch.table(heavy_keys(hooked, ["new"]), f"large{round_}")
        jumped = spread_join(hooked, top, ["new"], "node", large, "left").select("node", "old", F.least("new", F.coalesce("top", "new")).alias("component"))
        done = scratch.table(jumped, f"labels{round_}")
        for name in (f"labels{round_ - 1}", f"step{round_}", f"hooked{round_}"):
            scratch.drop(name)
        labels = done.select("node", "component")
        if not done.where("old <> component").limit(1).count():
            return labels
