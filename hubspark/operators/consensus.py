"""What a pool of partitions (iter, id, community) agrees on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph


def _together(graph: Graph, pool: DataFrame) -> DataFrame:
    """One row per edge and partition: 1 if both ends share a community."""
    a = pool.select("iter", F.col("id").alias("src"), F.col("community").alias("cs"))
    b = pool.select("iter", F.col("id").alias("dst"), F.col("community").alias("cd"))
    return graph.edges.join(a, "src").join(b, ["iter", "dst"]).select("iter", "src", "dst", "w", (F.col("cs") == F.col("cd")).cast("int").alias("same"))


def coassociation(graph: Graph, pool: DataFrame) -> DataFrame:
    """src, dst, co, w: share of the partitions that hold an edge's ends together."""
    return _together(graph, pool).groupBy("src", "dst").agg(F.avg("same").alias("co"), F.max("w").alias("w"))


def lead_counts(leaders: DataFrame, b: int) -> DataFrame:
    """id, n, freq: how often a node was a leader in a pool of ``b``."""
    return leaders.groupBy(F.col("leader").alias("id")).agg(F.count("*").alias("n"), (F.count("*") / F.lit(b)).alias("freq"))


def _both(co: DataFrame) -> DataFrame:
    return co.select(F.col("src").alias("id"), F.col("dst").alias("other"), "co").unionByName(co.select(F.col("dst").alias("id"), F.col("src").alias("other"), "co"))


def confidence(graph: Graph, co: DataFrame) -> DataFrame:
    """id, confidence: mean co-association of a node's edges; isolates 0."""
    per = _both(co).groupBy("id").agg(F.avg("co").alias("c"))
    return graph.nodes.select("id").join(per, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("confidence"))


def overlap(graph: Graph, m: DataFrame, co: DataFrame, tau: float = 0.7) -> DataFrame:
    """id, communities (sorted, home included), is_overlap.

    A node also joins the communities whose mean co-association with it is at
    least ``tau`` times the greatest among its neighbours' communities.
    """
    other = m.select(F.col("id").alias("other"), F.col("community").alias("community"))
    aff = _both(co).join(other, "other").groupBy("id", "community").agg(F.round(F.avg("co"), 9).alias("a"))
    near = aff.withColumn("top", F.max("a").over(W.partitionBy("id"))).where(F.col("a") >= tau * F.col("top")).select("id", "community")
    sets = near.unionByName(m.select("id", "community")).groupBy("id").agg(F.array_sort(F.collect_set("community")).alias("communities"))
    return sets.select("id", "communities", (F.size("communities") > 1).alias("is_overlap"))


def reweighted(graph: Graph, co: DataFrame, core: DataFrame, w_min: float = 0.05) -> DataFrame:
    """src, dst, w: the co-association scaled to [w_min, 1] on edges of the 2-core, w_min elsewhere."""
    inside = core.select("src", "dst").withColumn("_in", F.lit(True))
    return co.join(inside, ["src", "dst"], "left").select("src", "dst", F.when(F.col("_in"), w_min + (1 - w_min) * F.col("co")).otherwise(w_min).alias("w"))


def consensus_leaders(m: DataFrame, counts: DataFrame, central: DataFrame) -> DataFrame:
    """community, leader: greatest lead count, a central score below 1 breaks ties, then the least id."""
    top = central.agg((F.max("score") + 1).alias("top"))
    rows = m.join(counts.select("id", "n"), "id", "left").join(central.select("id", "score"), "id", "left").crossJoin(F.broadcast(top))
    value = F.coalesce("n", F.lit(0)) + F.coalesce("score", F.lit(0.0)) / F.col("top")
    return rows.groupBy("community").agg(F.max_by("id", F.struct(value.alias("v"), -F.col("id"))).alias("leader"))


def running_means(ks: DataFrame, trace: DataFrame) -> DataFrame:
    """Adds mu and n to a table of parameter pairs: mean Q of the iterations that drew each; 0 if none did."""
    per = trace.groupBy("k").agg(F.avg("q").alias("mu"), F.count("q").alias("n"))
    return ks.join(per, "k", "left").select(*ks.columns, F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("n", F.lit(0)).alias("n"))


def refresh(mu: DataFrame, best: DataFrame, floor: float) -> DataFrame:
    """k, p: probabilities in proportion to mu over the best Q, mixed with a uniform floor."""
    q = mu.crossJoin(F.broadcast(best)).select("k", (F.greatest("mu", F.lit(0.0)) / F.col("best")).alias("q"))
    total = q.agg(F.sum("q").alias("s"), F.count("*").alias("m"))
    share = F.when(F.col("s") > 0, F.col("q") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).otherwise(1.0 / F.col("m"))
    return q.crossJoin(F.broadcast(total)).select("k", ((1 - floor) * share + floor / F.col("m")).alias("p"))


def distinct_partitions(pool: DataFrame, q: DataFrame, band: float) -> DataFrame:
    """n_distinct, n: different partitions among those within ``band`` of the best Q.

    A partition is compared by its labels in id order; only their hash is kept.
    """
    top = q.agg((F.max("q") - band).alias("least"))
    good = q.crossJoin(F.broadcast(top)).where("q >= least").select("iter")
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("id", "community"))), lambda x: x["community"].cast("string")))
    prints = pool.join(F.broadcast(good), "iter").groupBy("iter").agg(F.sha2(text, 256).alias("s"))
    return prints.agg(F.countDistinct("s").alias("n_distinct"), F.count("*").alias("n"))


def drift(graph: Graph, pool: DataFrame, sizes: list[int]) -> DataFrame:
    """b, drift: mean change of the co-association from one pool size to the next; null for the first."""
    bs = graph.edges.sparkSession.createDataFrame([(b,) for b in sizes], "b int")
    rows = _together(graph, pool).join(F.broadcast(bs), F.col("iter") <= F.col("b")).groupBy("b", "src", "dst").agg(F.avg("same").alias("co"))
    before = F.lag("co").over(W.partitionBy("src", "dst").orderBy("b"))
    return rows.withColumn("prev", before).groupBy("b").agg(F.avg(F.abs(F.col("co") - F.col("prev"))).alias("drift"))
