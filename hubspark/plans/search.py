"""Multi-start searches for communities and leaders.

The starts are independent, so a whole block of them is one job: a row per
start, the graph broadcast once (behind a size check), the result a table
(iter, id, community, is_leader). Draws are hashes of seed, iteration and step:
the number of partitions or a retried task changes nothing.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.rng import coin, uniform_of
from ..operators import centrality as cen
from ..operators import consensus, metrics, quality
from ..operators.graph import Graph, cut

VARIANT_ROWS = "iter int, id bigint, community int, is_leader boolean, q double, h double"


def check_search(graph: Graph, b: int, alphas: tuple[float, ...], seed) -> None:
    if graph.nodes.limit(2).count() < 2 or not graph.edges.limit(1).count():
        raise ValueError("the graph needs at least two nodes and one edge")
    if not isinstance(b, int) or b < 1:
        raise ValueError("b must be a single integer of at least 1")
    if any(not 0 <= a <= 1 for a in alphas):
        raise ValueError("alpha values must be between 0 and 1")
    if isinstance(seed, bool) or not isinstance(seed, int | None):
        raise ValueError("seed must be a single integer, or None for a fresh one")


def central_scores(graph: Graph) -> DataFrame:
    """id, score: eigenvector centrality of a graph that a search has collected."""
    csr = kernels.collect(graph)
    return graph.nodes.sparkSession.createDataFrame(pd.DataFrame({"id": csr.ids, "score": kernels.central(csr, "eigen")}))


def fresh(seed: int | None) -> int:
    """The seed, or a new one; the result's parameters name it, so that any run can be repeated."""
    return secrets.randbits(31) if seed is None else seed


@dataclass(frozen=True)
class Result:
    """The best partition, its leaders, the traces and the parameters of a search."""

    method: str
    graph: Graph
    membership: DataFrame
    leaders: DataFrame
    trace: pd.DataFrame
    q: float
    h: float
    best_iter: int
    params: dict
    elapsed: float
    history: pd.DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def metrics(self, level: str = "overall", truth: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
        """The metric table of a level: ``overall``, ``community`` or ``leader``."""
        if level == "community":
            return metrics.community_table(self.graph, self.membership, self.leaders, truth)
        if level == "leader":
            central = central_scores(self.graph)
            return metrics.leader_table(self.graph, self.membership, self.leaders, scores, central)
        if level != "overall":
            raise ValueError("level must be overall, community or leader")
        spark = self.graph.nodes.sparkSession
        trace = spark.createDataFrame(self.trace[["iter", "q", "h"]].astype({"iter": "int64"}), "iter long, q double, h double")
        ran = {"best_iter": self.best_iter, "elapsed_sec": self.elapsed}
        if self.method == "reactive":
            decided = len(self.extra["h_decided"])
            ran |= {"lex_decisive_n": decided, "lex_decisive_pct": 100 * decided / len(self.trace)}
        pool = None
        if self.method == "ensemble":
            central = quality.central_leaders(self.membership, central_scores(self.graph))
            pool = metrics.consensus_row(self.leaders, central, self.extra["confidence"], self.extra["q_weighted"], self.extra.get("overlap"))
        return metrics.overall_table(self.graph, self.membership, self.leaders, self.method, truth, scores, trace, pool, ran)

    def __repr__(self) -> str:
        return f"<{self.method}: Q {self.q:.4f}, H {self.h:.4f}, {len(self.trace)} iterations, best {self.best_iter}>"


def run_block(spark, shared, starts: pd.DataFrame, seed: int, variant: int, centrality: str, sim: str, guard: bool, score) -> DataFrame:
    """(iter, id, community, is_leader, q, h) of the starts (iter, alpha_c, alpha_s), one task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                it = int(row.iter)
                com, _ = kernels.construct(g, row.alpha_c, row.alpha_s, seed, it, sim, centrality, score, each_round=variant == 2)
                com = kernels.local_search(g, com, seed, it, guard=guard)
                lead = kernels.repair(g, com, centrality)
                h = float(kernels.node_entropy(g.degree[lead], g.n).mean())
                yield pd.DataFrame({"iter": it, "id": g.ids, "community": com + 1, "is_leader": np.isin(np.arange(g.n), lead), "q": kernels.modularity(g, com), "h": h})

    return spark.createDataFrame(starts, "iter int, alpha_c double, alpha_s double").repartition(len(starts), "iter").mapInPandas(run, VARIANT_ROWS)


def fold(trace: pd.DataFrame, tol: float = 1e-12) -> tuple[int, list[int]]:
    """(best iteration, iterations that H decided) of a trace in order."""
    best, decided = None, []
    for r in trace.sort_values("iter").itertuples(index=False):
        if best is None:
            best = r
            continue
        if abs(r.q - best.q) < tol and abs(r.h - best.h) > tol:
            decided.append(int(r.iter))
        if r.q > best.q + tol or (abs(r.q - best.q) <= tol and r.h > best.h + tol):
            best = r
    return int(best.iter), decided


def _result(method, graph, rows, trace, params, began, history=None, **extra) -> Result:
    it, decided = fold(trace)
    best = rows.where(F.col("iter") == it)
    top = trace[trace["iter"] == it].iloc[0]
    return Result(method, graph, best.select("id", "community"), best.where("is_leader").select("community", F.col("id").alias("leader")), trace, float(top.q), float(top.h), it, params, time.time() - began, history, {"h_decided": decided, **extra})


def _traced(rows: DataFrame) -> pd.DataFrame:
    """One row per iteration: as many as starts."""
    return rows.groupBy("iter").agg(F.first("q").alias("q"), F.first("h").alias("h")).orderBy("iter").toPandas()


def grasp(graph: Graph, b: int = 50, alpha_c: float = 0.1, alpha_s: float = 0.3, variant: int = 1, centrality: str = "eigen", sim: str = "hpi", seed: int = 1, guard: bool = False) -> Result:
    """Fixed parameters: ``b`` starts, the best by modularity, then by leader entropy."""
    check_search(graph, b, (alpha_c, alpha_s), seed)
    seed = fresh(seed)
    cen.by_name(centrality)
    spark = graph.nodes.sparkSession
    csr = kernels.collect(graph)
    began = time.time()
    score = kernels.central(csr, centrality) if variant == 1 else None
    starts = pd.DataFrame({"iter": range(1, b + 1), "alpha_c": alpha_c, "alpha_s": alpha_s})
    rows = cut(run_block(spark, spark.sparkContext.broadcast(csr), starts, seed, variant, centrality, sim, guard, score))
    return _result("grasp", graph, rows, _traced(rows).assign(k=None, alpha_c=alpha_c, alpha_s=alpha_s), {"b": b, "alpha_c": alpha_c, "alpha_s": alpha_s, "variant": variant, "seed": seed}, began)


def reactive(graph: Graph, b: int = 150, m: int = 20, y: int | None = None, alpha_c: tuple[float, float] = (0.1, 0.9), alpha_s: tuple[float, float] = (0.1, 0.5), floor: float = 0.05, variant: int = 1, centrality: str = "eigen", sim: str = "hpi", seed: int = 1, guard: bool = False) -> Result:
    """Self-tuning: parameter pairs are drawn by probabilities that follow the quality they gave.

    The probabilities change only every ``y`` iterations (default 3 m), so each
    such block is one job.
    """
    check_search(graph, b, (*alpha_c, *alpha_s, floor), seed)
    seed = fresh(seed)
    if alpha_c[0] > alpha_c[1] or alpha_s[0] > alpha_s[1]:
        raise ValueError("alpha ranges must be ordered")
    y = y or 3 * m
    spark = graph.nodes.sparkSession
    csr = kernels.collect(graph)
    shared = spark.sparkContext.broadcast(csr)
    began = time.time()
    score = kernels.central(csr, centrality) if variant == 1 else None
    pairs = pd.DataFrame({"k": range(m), "alpha_c": [alpha_c[0] + (alpha_c[1] - alpha_c[0]) * uniform_of(seed, "c", k) for k in range(m)], "alpha_s": [alpha_s[0] + (alpha_s[1] - alpha_s[0]) * uniform_of(seed, "s", k) for k in range(m)]})
    p, rows, trace, history = np.full(m, 1 / m), None, pd.DataFrame(), []
    for first in range(1, b + 1, y):
        its = range(first, min(first + y, b + 1))
        k = [int(np.searchsorted(np.cumsum(p), uniform_of(seed, "k", it) * p.sum(), "right").clip(0, m - 1)) for it in its]
        starts = pd.DataFrame({"iter": its, "k": k}).merge(pairs, on="k").sort_values("iter")
        block = cut(run_block(spark, shared, starts[["iter", "alpha_c", "alpha_s"]], seed, variant, centrality, sim, guard, score))
        rows = block if rows is None else rows.unionByName(block)
        trace = pd.concat((trace, _traced(block).merge(starts, on="iter")))
        best = trace["q"].max()
        for it in its:
            if it % y == 0 and best > 0:
                q = np.maximum(pd.Series(trace.groupby("k")["q"].mean()).reindex(range(m)).fillna(0).to_numpy(), 0) / best
                p = q / q.sum() if q.sum() > 0 else np.full(m, 1 / m)
                p = (1 - floor) * p + floor / m
            history += [(it, j, float(x)) for j, x in enumerate(p)]
    return _result("reactive", graph, rows, trace, {"b": b, "m": m, "y": y, "floor": floor, "variant": variant, "seed": seed}, began, pd.DataFrame(history, columns=["iter", "k", "p"]), pairs=pairs)


def ensemble(graph: Graph, b: int = 64, w_min: float = 0.05, alpha_c: tuple[float, float] = (0.1, 0.9), alpha_s: tuple[float, float] = (0.1, 0.5), variant: int = 1, centrality: str = "eigen", sim: str = "hpi", tau: float | None = None, seed: int = 1) -> Result:
    """Consensus of ``b`` starts with fresh parameters each: edges weigh what the pool agrees on, and are clustered anew."""
    check_search(graph, b, (*alpha_c, *alpha_s, w_min), seed)
    seed = fresh(seed)
    spark = graph.nodes.sparkSession
    csr = kernels.collect(graph)
    began = time.time()
    score = kernels.central(csr, centrality) if variant == 1 else None
    draw = lambda name, r: [r[0] + (r[1] - r[0]) * uniform_of(seed, name, it) for it in range(1, b + 1)]
    starts = pd.DataFrame({"iter": range(1, b + 1), "alpha_c": draw("ec", alpha_c), "alpha_s": draw("es", alpha_s)})
    rows = cut(run_block(spark, spark.sparkContext.broadcast(csr), starts, seed, variant, centrality, sim, False, score))
    pool = rows.select("iter", "id", "community")
    co = cut(consensus.coassociation(graph, pool))
    weighted = cut(consensus.reweighted(graph, co, cen.two_core_edges(graph), w_min))
    m = cut(louvain(Graph(graph.nodes, weighted)))
    counts = consensus.lead_counts(rows.where("is_leader").select("iter", F.col("id").alias("leader")), b)
    ev = central_scores(graph)
    lead = cut(consensus.consensus_leaders(m, counts, ev))
    q = quality.modularity(graph, m).first()["q"]
    h = quality.entropy_global(graph, lead).first()["h"]
    extra = {"coassociation": co, "weights": weighted, "q_weighted": quality.modularity(Graph(graph.nodes, weighted), m).first()["q"], "confidence": consensus.confidence(graph, co), "lead_counts": counts}
    if tau is not None:
        extra["overlap"] = consensus.overlap(graph, m, co, tau)
    return Result("ensemble", graph, m, lead, _traced(rows).merge(starts, on="iter"), float(q), float(h), 0, {"b": b, "w_min": w_min, "variant": variant, "seed": seed}, time.time() - began, None, extra)


def louvain(graph: Graph) -> DataFrame:
    """(id, community) by multilevel clustering, in one task on the broadcast graph."""
    csr = kernels.collect(graph)
    spark = graph.nodes.sparkSession
    shared = spark.sparkContext.broadcast(csr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _ in range(len(batch)):
                yield pd.DataFrame({"id": shared.value.ids, "community": kernels.louvain(shared.value) + 1})

    return spark.range(1).coalesce(1).mapInPandas(run, "id bigint, community int")


def sample_nodes(graph: Graph, seed: int, n: int) -> DataFrame:
    """The n nodes of least hash: the same sample for every pass and every partitioning."""
    return graph.nodes.select("id").orderBy(coin(seed, "id"), "id").limit(n)


def proposals(graph: Graph, m: DataFrame, sample: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(id, community, gain): best move of each sampled node that gains over ``eps``; least community on ties."""
    g = quality.gains(graph, m, sample).withColumn("gain", F.round("gain", 9))
    best = g.groupBy("id").agg(F.max_by("target", F.struct("gain", -F.col("target"))).alias("community"), F.max("gain").alias("gain"))
    return best.where(F.col("gain") > eps)


def batch_search(graph: Graph, m: DataFrame, seed: int = 1, n: int = 300, eps: float = 1e-4, passes: int = 200) -> DataFrame:
    """(id, community): batch local search in DataFrame steps, for graphs too large for a broadcast."""
    sample = cut(sample_nodes(graph, seed, n))
    m = cut(m.select("id", "community"))
    for _ in range(passes):
        moves = cut(proposals(graph, m, sample, eps))
        if not moves.limit(1).count():
            break
        m = cut(m.join(moves.select("id", F.col("community").alias("_to")), "id", "left").select("id", F.coalesce("_to", "community").cast("int").alias("community")))
    return m


def detect(graph: Graph, method: str = "reactive", **how) -> Result:
    methods = {"grasp": grasp, "reactive": reactive, "ensemble": ensemble}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; one of {sorted(methods)}")
    return methods[method](graph, **how)
