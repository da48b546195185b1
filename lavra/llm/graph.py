"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import shared


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the nodes of a component share one root.

    Each round maps a node to the smallest of its neighbours and itself, and
    maps the edges along; the rounds' maps are put together at the end. Ids
    should be hashes, so that the graph shrinks by a constant factor in each
    round whatever its shape. Maps and edges are stored every round, until the
    end; an edge list is never gathered. They are files and not checkpoints,
    which would keep the planner's estimate of their size: joins multiply it,
    so its digits would triple with each round until they filled the driver.
    """
    spark, maps, first = edges.sparkSession, [], True
    edges, path = shared.store(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, of = shared.store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).withColumnRenamed("a", "id"), "parents")
        maps.append(of)
        if first:  # every node has an edge
            labels, first = parent.select(F.col("id").alias("node"), F.col("up").alias("root")), False
        else:
            labels = labels.join(parent, labels["root"] == parent["id"], "left").select("node", F.coalesce("up", "root").alias("root"))
        mapped = edges.join(parent, edges["a"] == parent["id"]).select(F.col("up").alias("a"), "b")
        mapped = mapped.join(parent, mapped["b"] == parent["id"]).select("a", F.col("up").alias("b")).filter("a != b")
        before = path
        edges, path = shared.store(mapped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        shared.drop(spark, before)
    labels = shared.checkpoint(labels)
    for stored in (path, *maps):
        shared.drop(spark, stored)
    return labels
