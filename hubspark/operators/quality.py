"""Scores of partitions: modularity and what it is made of, entropy scores of leaders, participation, coverage.

A membership table has id and community, and may have ``iter``: name it in
``by`` and all partitions are scored in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph

By = tuple[str, ...]


def ends(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """Each oriented edge with the communities of both ends: by, src, dst, w, cs, cd."""
    a = m.select(*by, F.col("id").alias("src"), F.col("community").alias("cs"))
    b = m.select(*by, F.col("id").alias("dst"), F.col("community").alias("cd"))
    return graph.adj.join(a, "src").join(b, [*by, "dst"]).select(*by, "src", "dst", "w", "cs", "cd")


def community_sums(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """by, community, size, vol (strengths), intra (both orientations), two_w."""
    strength = graph.strength()
    two_w = strength.agg(F.sum("strength").alias("two_w"))
    vol = m.join(strength, "id").groupBy(*by, "community").agg(F.count("*").alias("size"), F.sum("strength").alias("vol"))
    intra = ends(graph, m, by).where("cs = cd").groupBy(*by, F.col("cs").alias("community")).agg(F.sum("w").alias("intra"))
    return vol.join(intra, [*by, "community"], "left").withColumn("intra", F.coalesce("intra", F.lit(0.0))).crossJoin(F.broadcast(two_w))  # one row


def modularity(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """by, q. No weight at all: 0."""
    q = F.sum("intra") / F.max("two_w") - F.sum(F.col("vol") * F.col("vol")) / (F.max("two_w") * F.max("two_w"))
    return community_sums(graph, m, by).groupBy(*by).agg(F.when(F.max("two_w") > 0, q).otherwise(0.0).alias("q"))


def contributions(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """by, community, q_contribution; they add up to the modularity."""
    share = F.col("vol") / F.col("two_w")
    return community_sums(graph, m, by).select(*by, "community", F.when(F.col("two_w") > 0, F.col("intra") / F.col("two_w") - share * share).otherwise(0.0).alias("q_contribution"))


def affinity(graph: Graph, m: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """id, community, s: weight of the node into each community less what its strength would give it; ``only`` for the nodes (id) given."""
    strength = graph.strength()
    two_w = strength.agg(F.sum("strength").alias("two_w"))
    vol = m.join(strength, "id").groupBy("community").agg(F.sum("strength").alias("vol"))
    each, near = strength.select("id", "strength"), ends(graph, m).withColumnRenamed("src", "id")
    if only is not None:
        each, near = (df.join(only.select("id"), "id", "left_semi") for df in (each, near))
    into = near.groupBy("id", F.col("cd").alias("community")).agg(F.sum("w").alias("e"))
    # every node meets every community: nodes x communities is the result's own size
    grid = each.crossJoin(F.broadcast(vol)).crossJoin(F.broadcast(two_w))
    null_term = F.when(F.col("two_w") > 0, F.col("strength") * F.col("vol") / F.col("two_w")).otherwise(0.0)
    return grid.join(into, ["id", "community"], "left").select("id", "community", (F.coalesce("e", F.lit(0.0)) - null_term).alias("s"), "strength", "two_w")


def gains(graph: Graph, m: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """id, current, target, gain: change of modularity if the node moves; 0 for its own community."""
    s = affinity(graph, m, only)
    own = s.join(m, ["id", "community"]).select("id", F.col("community").alias("current"), F.col("s").alias("s_own"))
    move = (F.col("s") - F.col("s_own") - F.col("strength") * F.col("strength") / F.col("two_w")) / (F.col("two_w") / 2)
    return s.join(own, "id").select("id", "current", F.col("community").alias("target"), F.when(F.col("community") == F.col("current"), 0.0).otherwise(move).alias("gain"))


def binary_entropy(p: Column) -> Column:
    """In bits; 0 outside (0, 1)."""
    inside = (p > 0) & (p < 1)
    safe = F.when(inside, p).otherwise(0.5)
    return F.when(inside, -(safe * F.log2(safe) + (1 - safe) * F.log2(1 - safe))).otherwise(0.0)


def node_entropy(degree: Column, n: Column) -> Column:
    """Entropy of the share of nodes that are neighbours; at the ends of the scale (1 + log2 n) / n."""
    p = degree / n
    return F.when((p > 0) & (p < 1), binary_entropy(p)).otherwise((1 + F.log2(n)) / n)


def entropy_global(graph: Graph, leaders: DataFrame, by: By = ()) -> DataFrame:
    """by, h: mean node entropy of the leaders (structural degree)."""
    n = graph.nodes.agg(F.count("*").cast("double").alias("n"))
    deg = graph.strength().select(F.col("id").alias("leader"), "degree")
    return leaders.join(deg, "leader").crossJoin(F.broadcast(n)).groupBy(*by).agg(F.coalesce(F.avg(node_entropy(F.col("degree"), F.col("n"))), F.lit(0.0)).alias("h"))


def leader_links(graph: Graph, m: DataFrame, leaders: DataFrame, by: By = ()) -> DataFrame:
    """by, community, leader, size, inner (neighbours within the community)."""
    size = m.groupBy(*by, "community").agg(F.count("*").alias("size"))
    inner = ends(graph, m, by).where("cs = cd").groupBy(*by, F.col("src").alias("leader")).agg(F.count("*").alias("inner"))
    home = m.select(*by, F.col("id").alias("leader"), "community")
    return leaders.select(*by, "leader").join(home, [*by, "leader"]).join(size, [*by, "community"]).join(inner, [*by, "leader"], "left").withColumn("inner", F.coalesce("inner", F.lit(0)))


def entropy_local(graph: Graph, m: DataFrame, leaders: DataFrame, by: By = ()) -> DataFrame:
    """by, h: mean entropy of the share of the leader's community that it knows; a single node counts as 0."""
    share = F.least(F.greatest(F.col("inner") / F.greatest(F.col("size") - 1, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return leader_links(graph, m, leaders, by).groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("size") > 1, binary_entropy(share)).otherwise(0.0)), F.lit(0.0)).alias("h"))


def mixed_leaders(graph: Graph, m: DataFrame, mix: float = 0.5) -> DataFrame:
    """community, leader, score: best mix of local and global entropy (0 at the ends of the scale), least id on ties."""
    n = graph.nodes.agg(F.count("*").cast("double").alias("n"))
    deg = graph.strength().select("id", "degree")
    links = leader_links(graph, m, m.select(F.col("id").alias("leader")))
    local = F.when(F.col("size") > 1, binary_entropy(F.col("inner") / F.greatest(F.col("size") - 1, F.lit(1)))).otherwise(0.0)
    score = F.round(mix * local + (1 - mix) * binary_entropy(F.col("degree") / F.col("n")), 9)
    scored = links.join(deg, F.col("leader") == F.col("id")).crossJoin(F.broadcast(n)).select("community", "leader", score.alias("score"))
    return scored.groupBy("community").agg(F.max_by("leader", F.struct("score", -F.col("leader"))).alias("leader"), F.max("score").alias("score"))


def participation(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """by, id, participation: 1 less the sum of squared shares of strength by community; isolates 0."""
    per = ends(graph, m, by).groupBy(*by, F.col("src").alias("id"), "cd").agg(F.sum("w").alias("k"))
    score = per.groupBy(*by, "id").agg((1 - F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("participation"))
    return m.select(*by, "id").join(score, [*by, "id"], "left").withColumn("participation", F.coalesce("participation", F.lit(0.0)))


def coverage(graph: Graph, leaders: DataFrame) -> DataFrame:
    """One row: share of nodes that are a leader or next to one."""
    l_ = leaders.select(F.col("leader").alias("id")).distinct()
    near = graph.adj.join(l_.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    reached = l_.union(near).distinct().agg(F.count("*").alias("reached"))
    n = graph.nodes.agg(F.count("*").alias("n"))
    return reached.crossJoin(F.broadcast(n)).select((F.col("reached") / F.col("n")).alias("coverage"))


def two_hop_coverage(graph: Graph, m: DataFrame, leaders: DataFrame) -> DataFrame:
    """community, leader, coverage: share of the community within two steps of its leader; paths may leave it."""
    adj = graph.adj.select("src", "dst")
    start = leaders.select("leader")
    one = start.join(adj, F.col("leader") == F.col("src")).select("leader", F.col("dst").alias("id"))
    two = one.join(adj.withColumnRenamed("src", "id").withColumnRenamed("dst", "far"), "id").select("leader", F.col("far").alias("id"))
    reach = one.unionByName(two).unionByName(start.select("leader", F.col("leader").alias("id"))).distinct()
    home = m.select(F.col("id").alias("leader"), F.col("community").alias("home"))
    size = m.groupBy("community").agg(F.count("*").alias("size"))
    inside = reach.join(home, "leader").join(m, "id").where("home = community").groupBy("community", "leader").agg(F.count("*").alias("reached"))
    return inside.join(size, "community").select("community", "leader", (F.col("reached") / F.col("size")).alias("coverage"))


def size_stats(m: DataFrame, by: By = ()) -> DataFrame:
    """by, n_communities, size_min, size_median, size_mean, size_max, size_sd (0 for one community), singleton_communities."""
    size = m.groupBy(*by, "community").agg(F.count("*").alias("size"))
    return size.groupBy(*by).agg(
        F.count("*").alias("n_communities"),
        F.min("size").alias("size_min"),
        F.median("size").alias("size_median"),
        F.avg("size").alias("size_mean"),
        F.max("size").alias("size_max"),
        F.coalesce(F.stddev_samp("size"), F.lit(0.0)).alias("size_sd"),
        F.count_if(F.col("size") == 1).alias("singleton_communities"),
    )


def central_leaders(m: DataFrame, central: DataFrame) -> DataFrame:
    """community, leader: the node of the greatest score (id, score) over the whole graph, least id on ties; for partitions that come without leaders."""
    s = central.select("id", F.round("score", 12).alias("score"))  # the last digits depend on the order of sums
    return m.join(s, "id").groupBy("community").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("leader"))


def top_degree_leaders(graph: Graph, m: DataFrame, by: By = ()) -> DataFrame:
    """by, community, leader: the node of greatest strength, least id on ties."""
    s = graph.strength().select("id", "strength")
    return m.join(s, "id").groupBy(*by, "community").agg(F.max_by("id", F.struct("strength", -F.col("id"))).alias("leader"))
