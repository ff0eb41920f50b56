"""Centralities: power iterations as joins, and path-based ones with the sources dealt over the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .graph import Graph, cut


def eigen_steps(graph: Graph, steps: int) -> DataFrame:
    """id, score after ``steps`` unshifted power steps from equal values, scaled to the greatest each time, then to sum 1.

    Edge weights do not count. A graph without edges keeps 1 / sqrt(n).
    """
    n = graph.nodes.count()
    x = graph.nodes.select("id", F.lit(1.0 / n**0.5 if n else 0.0).alias("score"))
    adj = graph.adj.select("src", "dst")
    if not adj.limit(1).count():
        return x
    for _ in range(steps):
        y = adj.join(x.select(F.col("id").alias("dst"), "score"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("score").alias("score"))
        y = cut(graph.nodes.select("id").join(y, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")))
        top = y.agg(F.max("score").alias("top"))
        x = y.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("score"))
    total = x.agg(F.sum("score").alias("total"))
    return x.crossJoin(F.broadcast(total)).select("id", (F.col("score") / F.col("total")).alias("score"))


def eigen(graph: Graph, tol: float = 1e-10, max_iter: int = 1000, weighted: bool = False, shifted: bool = False) -> DataFrame:
    """id, score to convergence of the summed change; ``shifted`` iterates with A + I, which also settles on bipartite graphs."""
    n = graph.nodes.count()
    x = cut(graph.nodes.select("id", F.lit(1.0 / n**0.5 if n else 0.0).alias("score")))
    adj = cut(graph.adj)
    if not adj.limit(1).count():
        return x
    for _ in range(max_iter):
        y = adj.join(x.select(F.col("id").alias("dst"), "score"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("score") * (F.col("w") if weighted else F.lit(1.0))).alias("y"))
        step = cut(x.join(y, "id", "left").select("id", "score", (F.coalesce("y", F.lit(0.0)) + (F.col("score") if shifted else F.lit(0.0))).alias("y")))
        top = step.agg(F.max("y").alias("t")).first()["t"]
        change = step.agg(F.sum(F.abs(F.col("y") / top - F.col("score"))).alias("d")).first()["d"]
        x = step.select("id", (F.col("y") / top).alias("score"))
        if change < tol:
            break
    total = x.agg(F.sum("score").alias("s")).first()["s"]
    return x.select("id", (F.col("score") / total).alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, steps: int = 30) -> DataFrame:
    """id, score; nodes without edges give their share to all."""
    deg = cut(graph.strength().select("id", "degree"))
    n = deg.count()
    x = deg.select("id", "degree", F.lit(1.0 / n).alias("score"))
    adj = cut(graph.adj.select("src", "dst"))
    for _ in range(steps):
        loose = x.where("degree = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()["s"]
        sent = x.where("degree > 0").select(F.col("id").alias("dst"), (F.col("score") / F.col("degree")).alias("part"))
        got = adj.join(sent, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("part").alias("got"))
        x = cut(deg.join(got, "id", "left").select("id", "degree", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("score")))
    return x.select("id", "score")


def leaderrank(graph: Graph, damping: float = 0.85, steps: int = 50) -> DataFrame:
    """id, score: PageRank on the graph with a ground node joined to every node; the ground node, of an id below all, is left out."""
    least = graph.nodes.agg(F.min("id").alias("least")).first()["least"] or 0
    ground = graph.nodes.select(F.lit(least - 1).cast("bigint").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    nodes = graph.nodes.select("id").unionByName(graph.nodes.sparkSession.range(least - 1, least))
    return pagerank(Graph(nodes, graph.edges.select("src", "dst", "w").unionByName(ground)), damping, steps).where(F.col("id") >= least)


def two_core_edges(graph: Graph) -> DataFrame:
    """Edges whose ends keep two neighbours when nodes of fewer are peeled away again and again."""
    edges = cut(graph.edges.select("src", "dst", "w"))
    while True:
        deg = Graph(graph.nodes, edges).adj.groupBy("src").agg(F.count("*").alias("k")).where("k >= 2").select("src")
        left = cut(edges.join(deg, "src", "left_semi").join(deg.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "w"))
        if left.count() == edges.count():
            return left
        edges = left


def coreness(graph: Graph) -> DataFrame:
    """id, core: by peeling k = 1, 2, ...; each round drops all nodes of degree k or less at once."""
    adj = cut(graph.adj.select("src", "dst"))
    done = graph.nodes.select("id").join(adj.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("core", F.lit(0))
    k = 1
    while adj.limit(1).count():
        weak = cut(adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).where(F.col("d") <= k).select("id"))
        if not weak.limit(1).count():
            k += 1
            continue
        left = cut(adj.join(weak.withColumnRenamed("id", "src"), "src", "left_anti").join(weak.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        # nodes whose last neighbours have just gone have the same core number
        gone = adj.select(F.col("src").alias("id")).distinct().join(left.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        done = cut(done.unionByName(gone.withColumn("core", F.lit(k))))
        adj = left
    return done


def _by_source(graph: Graph, kernel, schema: str) -> DataFrame:
    """Runs ``kernel(csr, sources)`` over the nodes; the arrays are broadcast once, behind a size check."""
    csr = kernels.collect(graph)
    shared = graph.nodes.sparkSession.sparkContext.broadcast(csr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield kernel(shared.value, shared.value.places(batch["id"].to_numpy()))

    spark = graph.nodes.sparkSession
    return graph.nodes.select("id").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema)


def betweenness(graph: Graph) -> DataFrame:
    """id, score: shortest-path betweenness of the unweighted graph, each pair once."""

    def part(csr, sources):
        return pd.DataFrame({"id": csr.ids, "score": kernels.dependencies(csr, sources)})

    return _by_source(graph, part, "id bigint, score double").groupBy("id").agg((F.sum("score") / 2).alias("score"))


def closeness(graph: Graph) -> DataFrame:
    """id, score: (n - 1) / total distance if the graph is connected, else mean of inverse distances."""

    def part(csr, sources):
        near, far, reached = kernels.distances(csr, sources)
        return pd.DataFrame({"id": csr.ids[sources], "total": far, "inverse": near, "reached": reached})

    rows = cut(_by_source(graph, part, "id bigint, total double, inverse double, reached bigint"))
    n = rows.count()
    whole = rows.where(F.col("reached") < n).limit(1).count() == 0
    if n < 2:
        return rows.select("id", F.lit(None).cast("double").alias("score"))
    return rows.select("id", ((n - 1) / F.col("total") if whole else F.col("inverse") / (n - 1)).alias("score"))


def hop_distances(graph: Graph, start: int, most: int = 100) -> DataFrame:
    """id, distance from one node by frontier joins; nodes out of reach do not appear."""
    adj = cut(graph.adj.select("src", "dst"))
    seen = cut(graph.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("distance")))
    for step in range(1, most + 1):
        edge = seen.where(F.col("distance") == step - 1).select(F.col("id").alias("src"))
        new = adj.join(edge, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(step))
        after = cut(seen.unionByName(new))
        if after.count() == seen.count():
            break
        seen = after
    return seen


#: Names for search and seeding; each gives (id, score).
CENTRALITIES = {"degree": lambda g: g.strength().select("id", F.col("strength").alias("score")), "eigen": eigen, "betweenness": betweenness, "closeness": closeness}


def by_name(name: str):
    if name not in CENTRALITIES:
        raise ValueError(f"unknown centrality {name!r}; one of {sorted(CENTRALITIES)}")
    return CENTRALITIES[name]
