"""Connected components of an edge table, as DataFrame rounds of large-star and small-star, and of one that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise, materialise_at, remove


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that goes by shuffle: a broadcast passes the driver, and there is one a join and round."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component): the smallest node each node reaches. Nodes without edges don't appear.

    Each round joins edges to a minimum per node and cuts its lineage into the shared folder; no edge or label reaches
    the driver. Rounds end when the edges (then a star around each smallest node) stay the same.
    """
    edges, path = materialise_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(shuffled(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(shuffled(low), "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        done = path
        edges, path = materialise_at(small.select("e.*").where("a <> b").distinct())
        remove(edges.sparkSession, done)
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def grow(labels: DataFrame, merges: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes up new edges (a, b): the labels of new nodes, to be added to labels, and the merges that replace merges.

    labels (node, component): each node once, with the component that it first had; never rewritten. merges (component, into):
    where components have gone since; see grown(). Rounds run over the new edges only, whose ends are replaced by their
    components; of the old labels, those of the ends are read.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    ends = nodes.join(shuffled(labels), "node", "left").join(shuffled(merges), "component", "left")
    ends = materialise(ends.select("node", F.col("component").isNotNull().alias("old"), F.coalesce("into", "component", "node").alias("root")))
    end = lambda k: ends.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    contracted = edges.join(shuffled(end("a")), "a").join(shuffled(end("b")), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    found = materialise(components(contracted).select(F.col("node").alias("root"), F.col("component").alias("now")))
    added = ends.where("not old").join(shuffled(found), "root", "left").select("node", F.coalesce("now", "root").alias("component"))
    moved = ends.where("old").select("root").distinct().join(shuffled(found), "root").where("now <> root")
    kept = merges.join(shuffled(moved), F.col("into") == F.col("root"), "left").select("component", F.coalesce("now", "into").alias("into"))
    return added, kept.unionByName(moved.select(F.col("root").alias("component"), F.col("now").alias("into")))


def grown(labels: DataFrame, merges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node reaches by all edges so far."""
    return labels.join(shuffled(merges), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
