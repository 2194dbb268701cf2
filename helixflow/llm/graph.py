"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def settled(e: DataFrame) -> bool:
    """Whether edges (u, v), each with u > v, are stars around their least nodes: no node points to two, or to one that
    points on. One aggregation, combined before its shuffle."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("off"), F.lit(0).alias("on"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("off"), F.lit(1).alias("on")))
    return ends.groupBy("node").agg(F.sum("off").alias("off"), F.max("on").alias("on")).where("off > 1 or (off = 1 and on = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of edges (a, b); loops and repeats don't matter.

    Each round is two aggregations and joins by node, written to the shared folder. A star's centre has as many rows as
    leaves, of two longs each; minima are combined before the shuffle, and the joins can be split.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        if settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, e = e, materialise(small)
        release(before)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = materialise(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots))
    release(e)
    return out


def joined_components(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    """components of comps' own edges and of edges (a, b) together. Only edges between different components count anew,
    as edges of these components."""
    if comps is None:
        return components(edges)
    for end in ("a", "b"):
        names = comps.select(F.col("node").alias(end), F.col("comp").alias("name"))
        edges = edges.join(names, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    found = components(edges)
    if found.isEmpty():
        release(found)
        return comps
    new = comps.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
    out = materialise(new.unionByName(found.join(comps.select("node"), "node", "left_anti").select("node", "comp")))
    release(comps, found)
    return out
