"""Connected components of an undirected graph given as edges, without hubs, driver state or unbounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Rows (node, label): the smallest node of each component, for every node with an edge. ``edges`` has bigint src, dst.

    Each round gives a node the smallest label among itself and its neighbours, then jumps to that label's own label, so
    chains shorten geometrically. Edges stay as they are, so no node gains neighbours; minima combine before the shuffle.
    Each round is written to the shared folder; it ends when no label changes.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label"), F.lit(True).alias("changed")), f"{tag}-0")
    turn = 0
    while labels.where("changed").limit(1).count():
        turn += 1
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = hooked.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("changed"))
        last, labels = labels, materialize(moved, f"{tag}-{turn}")
        drop(last)
    drop(both)
    return labels.select("node", "label")
