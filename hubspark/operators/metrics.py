"""The tidy metric tables: overall, by community and by leader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quality, recovery
from .graph import Graph, names
from .windows import percentile_in, rank_in


def community_table(graph: Graph, m: DataFrame, leaders: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row per community; of several leaders of one the last counts, as in a table keyed by community."""
    sums = quality.community_sums(graph, m)
    counts = quality.ends(graph, m).groupBy(F.col("cs").alias("community")).agg((F.count_if(F.col("cs") == F.col("cd")) / 2).cast("bigint").alias("internal_edges"), F.count_if(F.col("cs") != F.col("cd")).alias("boundary_edges"))
    lead = leaders.join(m.withColumnRenamed("id", "leader").withColumnRenamed("community", "home"), "leader").groupBy(F.col("home").alias("community")).agg(F.max("leader").alias("leader"))
    named = graph.nodes.select(F.col("id").alias("leader"), names(graph.nodes).alias("leader_name"))
    strength = graph.strength().select(F.col("id").alias("leader"), F.col("strength").alias("leader_degree"))
    size, cut = F.col("size"), F.col("vol") - F.col("intra")
    pairs = size * (size - 1) / 2
    least = F.least(F.col("vol"), F.col("two_w") - F.col("vol"))
    out = sums.join(counts, "community", "left").join(lead, "community", "left").join(named, "leader", "left").join(strength, "leader", "left")
    share = F.col("vol") / F.col("two_w")
    out = out.select(
        "community", "size", "leader", "leader_name", "leader_degree",
        F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce("boundary_edges", F.lit(0)).alias("boundary_edges"),
        F.when(size > 1, F.coalesce("internal_edges", F.lit(0)) / F.when(size > 1, pairs).otherwise(1.0)).alias("internal_density"),
        F.when(least > 0, cut / F.when(least > 0, least).otherwise(1.0)).alias("conductance"),
        (F.col("intra") / F.col("two_w") - share * share).alias("q_contribution"),
    )
    if truth is None:
        return out
    pure = recovery.purity(recovery.contingency(truth.select("id", F.col("truth").alias("x")), m.select("id", F.col("community").alias("y"))))
    return out.join(pure.select(F.col("y").alias("community"), F.col("dominant").alias("truth_dominant"), "purity"), "community", "left")


def leader_table(graph: Graph, m: DataFrame, leaders: DataFrame, scores: DataFrame | None = None, central: DataFrame | None = None) -> DataFrame:
    """One row per leader, in order of its community; ranks and percentiles are among the community's nodes.

    central: (id, score) of the whole graph, scaled to a greatest value of 1 as ``eigen_centrality``.
    """
    strength = graph.strength()
    n = graph.nodes.agg(F.count("*").cast("double").alias("n"))
    inner = quality.ends(graph, m).where("cs = cd").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree_within"))
    ranked = m.join(strength, "id").select("id", "community", "degree", "strength", rank_in("community", "strength").alias("degree_rank_in_community"), percentile_in("community", "strength").alias("degree_pctile_in_community"), F.count("*").over(W.partitionBy("community")).alias("community_size"))
    if scores is not None:
        ranked = ranked.join(scores.select("id", "score"), "id").withColumn("score_rank", rank_in("community", "score")).withColumn("score_pctile", percentile_in("community", "score"))
    rows = ranked.join(leaders.select(F.col("leader").alias("id")).distinct(), "id", "left_semi").join(inner, "id", "left").join(quality.participation(graph, m), "id").crossJoin(F.broadcast(n))
    rows = rows.join(graph.nodes.select("id", names(graph.nodes).alias("name")), "id")
    if central is not None:
        top = central.agg(F.max("score").alias("_top"))
        rows = rows.join(central.select("id", F.col("score").alias("_central")), "id").crossJoin(F.broadcast(top)).withColumn("eigen_centrality", F.when(F.col("_top") > 0, F.col("_central") / F.col("_top")))
    within = F.coalesce("degree_within", F.lit(0.0))
    extra = [F.col(c) for c in ("score", "score_rank", "score_pctile") if scores is not None] + [F.col("eigen_centrality")] * (central is not None)
    return rows.select(
        "community", F.col("id").alias("leader"), "name", "community_size", F.col("strength").alias("degree"), within.alias("degree_within"), (F.col("strength") - within).alias("degree_between"),
        quality.node_entropy(F.col("degree"), F.col("n")).alias("nce_node"), "participation", "degree_rank_in_community", "degree_pctile_in_community", *extra,
    ).orderBy("community", "leader")


def tidy(wide: DataFrame, algorithm: str, scope: str) -> DataFrame:
    """algorithm, scope, metric, value from one row of numbers."""
    cols = wide.columns
    doubles = wide.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot([], cols, "metric", "value").select(F.lit(algorithm).alias("algorithm"), F.lit(scope).alias("scope"), "metric", "value")


def consensus_row(leaders: DataFrame, central: DataFrame, confidence: DataFrame, q_weighted: float, overlap: DataFrame | None = None) -> DataFrame:
    """One row: what a pool's consensus adds to a partition.

    ``central`` are the communities' leaders by centrality; agreement is between the two sets of nodes.
    """
    agree = leaders.select("leader").intersect(central.select("leader")).agg(F.count("*").alias("leaders_agree_with_central"))
    out = confidence.agg(F.lit(float(q_weighted)).alias("q_consensus_weighted"), F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"))
    out = out.crossJoin(F.broadcast(agree)).crossJoin(F.broadcast(leaders.agg(F.count("*").alias("_n"))))
    out = out.withColumn("leaders_agree_frac", F.col("leaders_agree_with_central") / F.col("_n")).drop("_n")
    if overlap is not None:
        out = out.crossJoin(F.broadcast(overlap.agg(F.count_if("is_overlap").alias("overlap_nodes"), F.avg(F.col("is_overlap").cast("int")).alias("overlap_frac"))))
    return out


def overall_table(graph: Graph, m: DataFrame, leaders: DataFrame, algorithm: str, truth: DataFrame | None = None, scores: DataFrame | None = None, trace: DataFrame | None = None, consensus: DataFrame | None = None, ran: dict[str, float] | None = None, derived: bool = False) -> DataFrame:
    """Long table algorithm, scope, metric, value; scopes whose input is missing are absent, not 0.

    ran: further numbers of the search (with a trace); derived: the leaders were not given but derived.
    """
    one = lambda df, other: df.crossJoin(F.broadcast(other))  # noqa: E731  one row each
    base = graph.nodes.agg(F.count("*").alias("n_nodes"))
    base = one(base, graph.edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total_edge_weight")))
    base = one(one(base, quality.size_stats(m)), quality.modularity(graph, m))
    lead = leaders.join(graph.strength(), F.col("leader") == F.col("id")).join(quality.participation(graph, m), "id")
    led = lead.agg(F.count("*").alias("n_leaders"), F.avg("strength").alias("leader_degree_mean"), F.max("strength").alias("leader_degree_max"), F.avg("participation").alias("leader_participation_mean"))
    led = one(one(one(led, quality.entropy_global(graph, leaders).withColumnRenamed("h", "h_global")), quality.entropy_local(graph, m, leaders).withColumnRenamed("h", "h_local")), quality.coverage(graph, leaders).withColumnRenamed("coverage", "leader_coverage"))
    led = led.withColumn("leaders_derived", F.lit(int(derived)))
    out = tidy(base, algorithm, "partition").unionByName(tidy(led, algorithm, "leaders"))
    if scores is not None:
        t = leader_table(graph, m, leaders, scores)
        out = out.unionByName(tidy(t.agg(F.avg("score_pctile").alias("score_pctile_mean"), F.avg((F.col("score_rank") <= 1).cast("int")).alias("score_top1_rate"), F.avg((F.col("score_rank") <= 3).cast("int")).alias("score_top3_rate")), algorithm, "leader_score"))
    if truth is not None:
        table = recovery.contingency(truth.select("id", F.col("truth").alias("x")), m.select("id", F.col("community").alias("y")))
        kinds = truth.agg(F.countDistinct("truth").alias("n_communities_truth"))
        out = out.unionByName(tidy(one(recovery.agreement(table).drop("n"), kinds), algorithm, "recovery"))
    if trace is not None:
        s = trace.agg(F.count("*").alias("b"), F.avg("q").alias("trace_q_mean"), F.stddev_samp("q").alias("trace_q_sd"), F.min("q").alias("trace_q_min"), F.max("q").alias("trace_q_max"), F.avg("h").alias("trace_h_mean"))
        s = s.withColumns({k: F.lit(float(v)) for k, v in (ran or {}).items()})
        out = out.unionByName(tidy(s, algorithm, "search"))
    if consensus is not None:
        out = out.unionByName(tidy(consensus, algorithm, "consensus"))
    return out
