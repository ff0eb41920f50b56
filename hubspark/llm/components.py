"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .textops import cut


#: A node with more than this and 1/HUBS of the edges is a hub; so there are at most 2 * HUBS of them.
HUB_DEGREE, HUBS = 100, 512


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> Row:
    """n edges, the greatest degree and whether a node is no star's centre or has not one centre alone, in one job."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    loose = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))
    return per.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.max("n").alias("degree"), F.coalesce(F.bool_or(loose), F.lit(False)).alias("loose")).first()


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """One step over edges (u, v), u > v.

    large: each node hands its least neighbour to its larger neighbours;
    small: to its smaller ones and itself. The least neighbour comes from a
    group-by (combined before the shuffle). hub: the degree beyond which nodes
    are hubs, None if there are none; the few hubs' least neighbours are
    broadcast, so that a hub does not gather its edges in one task.
    """
    both = _both(edges) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if hub is not None:
        hubs = least.where(F.col("n") > hub).select("u", F.col("m").alias("hm"))
        marked = both.join(F.broadcast(hubs), "u", "left")
        joined = marked.where("hm is null").drop("hm").join(least.select("u", "m"), "u").unionByName(marked.where("hm is not null").withColumnRenamed("hm", "m"))
    else:
        joined = both.join(least.select("u", "m"), "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node of an undirected edge table; component is the least reachable id.

    Rows with a null end and loops are ignored, repeated edges count once.
    Nodes without an edge do not appear. Each round is checkpointed; the end is
    reached when each node with a smaller neighbour has one alone and no larger
    one: stars around their least nodes.
    """
    both_known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = both_known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    while (mark := _mark(e))["loose"]:
        # a large step leaves no more edges, and no node more smaller neighbours, than there were: one look serves both
        hub = max(HUB_DEGREE, mark["n"] // HUBS)
        hub = hub if mark["degree"] > hub else None
        e = cut(_star(_star(e, True, hub), False, hub))
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
