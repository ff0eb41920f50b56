"""Spread of influence: independent cascade and linear threshold, all simulations in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import coin, uniform
from .graph import Graph, cut


def _sims(graph: Graph, seeds: DataFrame, mc: int) -> DataFrame:
    runs = graph.nodes.sparkSession.range(1, mc + 1).select(F.col("id").cast("int").alias("mc"))
    return seeds.select("id").distinct().crossJoin(F.broadcast(runs)).select("mc", "id")


def cascade(graph: Graph, seeds: DataFrame, p: float, mc: int, seed: int = 1) -> DataFrame:
    """mc, id: nodes active at the end of each simulation.

    An edge passes influence with chance p, once; that is the same as keeping
    it with chance p beforehand and taking what the seeds reach.
    """
    runs = graph.nodes.sparkSession.range(1, mc + 1).select(F.col("id").cast("int").alias("mc"))
    live = cut(graph.edges.crossJoin(F.broadcast(runs)).where(coin(seed, "mc", "src", "dst") < int(p * 2**32)).select("mc", "src", "dst"))
    both = live.unionByName(live.select("mc", F.col("dst").alias("src"), F.col("src").alias("dst")))
    active = cut(_sims(graph, seeds, mc))
    front = active
    while True:
        new = both.join(front.withColumnRenamed("id", "src"), ["mc", "src"]).select("mc", F.col("dst").alias("id")).distinct().join(active, ["mc", "id"], "left_anti")
        front = cut(new)
        if not front.limit(1).count():
            return active
        active = cut(active.unionByName(front))


def threshold(graph: Graph, seeds: DataFrame, mc: int, seed: int = 1, rounds: int | None = None) -> DataFrame:
    """mc, id: nodes active at the end (or after ``rounds``): a node joins when the share of active neighbours reaches its threshold."""
    deg = cut(graph.strength().select("id", "degree"))
    adj = cut(graph.adj.select("src", "dst"))
    active = cut(_sims(graph, seeds, mc))
    done = 0
    while rounds is None or done < rounds:
        near = active.join(adj.withColumnRenamed("src", "id"), "id").groupBy("mc", F.col("dst").alias("id")).agg(F.count("*").alias("k"))
        new = cut(near.join(deg, "id").where(F.col("k") / F.col("degree") >= uniform(seed, "mc", "id")).select("mc", "id").join(active, ["mc", "id"], "left_anti"))
        if not new.limit(1).count():
            break
        active, done = cut(active.unionByName(new)), done + 1
    return active


def spread(active: DataFrame, n: int) -> DataFrame:
    """One row: mean, sd and the 2.5 and 97.5 % points of the share of active nodes."""
    per = active.groupBy("mc").agg((F.count("*") / F.lit(float(n))).alias("share"))
    return per.agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"), F.percentile("share", 0.025).alias("lo"), F.percentile("share", 0.975).alias("hi"))


def greedy_seeds(graph: Graph, k: int, candidates: DataFrame, p: float, mc: int, seed: int = 1) -> list[int]:
    """k seeds, each the candidate that adds most to the mean cascade; every candidate of a round is scored in one plan.

    With live edges fixed by the coin, what a candidate reaches is its
    component in each simulation; components are found once.
    """
    runs = graph.nodes.sparkSession.range(1, mc + 1).select(F.col("id").cast("int").alias("mc"))
    labels = cut(graph.nodes.select("id").crossJoin(F.broadcast(runs)).select("mc", "id", F.col("id").alias("c")))
    live = cut(graph.edges.crossJoin(F.broadcast(runs)).where(coin(seed, "mc", "src", "dst") < int(p * 2**32)).select("mc", "src", "dst"))
    both = live.unionByName(live.select("mc", F.col("dst").alias("src"), F.col("src").alias("dst")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), ["mc", "dst"]).groupBy("mc", F.col("src").alias("id")).agg(F.min("c").alias("o"))
        after = cut(labels.join(near, ["mc", "id"], "left").select("mc", "id", "c", F.least("c", F.coalesce("o", "c")).alias("n")))
        moved = after.where("n <> c").limit(1).count()
        labels = after.select("mc", "id", F.col("n").alias("c"))
        if not moved:
            break
    size = labels.groupBy("mc", "c").agg(F.count("*").alias("size"))
    value = cut(labels.join(candidates.select("id").distinct(), "id").join(size, ["mc", "c"]))
    chosen: list[int] = []
    while len(chosen) < k:
        taken = value.where(F.col("id").isin(chosen)).select("mc", "c").distinct() if chosen else None
        left = value.where(~F.col("id").isin(chosen)) if chosen else value
        worth = left if taken is None else left.join(taken.withColumn("_t", F.lit(1)), ["mc", "c"], "left").withColumn("size", F.when(F.col("_t").isNull(), F.col("size")).otherwise(0))
        best = worth.groupBy("id").agg(F.sum("size").alias("gain")).orderBy(F.desc("gain"), "id").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["id"])
    return chosen


def leader_influence(graph: Graph, m: DataFrame, leaders: DataFrame, p: float, mc: int, seed: int = 1) -> DataFrame:
    """community, leader, size, within: mean share of its own community that a leader's cascade reaches."""
    live = graph.edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").select("src", "dst", "w")
    reached = cascade(Graph(graph.nodes, live), leaders.select(F.col("leader").alias("id")), p, mc, seed)
    size = m.groupBy("community").agg(F.count("*").alias("size"))
    per = reached.join(m, "id").groupBy("community").agg((F.count("*") / F.lit(mc)).alias("mean"))
    return leaders.select("community", "leader").join(size, "community").join(per, "community", "left").select("community", "leader", "size", (F.coalesce("mean", F.lit(0.0)) / F.col("size")).alias("within"))
