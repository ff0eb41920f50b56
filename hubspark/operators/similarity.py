"""Neighbourhood similarities and restricted candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph


def common_neighbours(graph: Graph, starts: DataFrame) -> DataFrame:
    """start, id, common: neighbours that each start shares with each node two steps away.

    The starts are filtered before the two-hop join, so its cost follows their
    neighbourhoods, not the graph.
    """
    adj = graph.adj.select("src", "dst")
    first = adj.join(starts.select(F.col("start").alias("src")), "src").select(F.col("src").alias("start"), F.col("dst").alias("mid"))
    second = adj.select(F.col("src").alias("mid"), F.col("dst").alias("id"))
    return first.join(second, "mid").groupBy("start", "id").agg(F.count("*").alias("common"))


def _measure(kind: str) -> Column:
    c, a, b = F.col("common"), F.col("k_start"), F.col("k_id")
    divisor = {"hpi": F.least(a, b), "dice": a + b, "jaccard": a + b - c}
    if kind not in divisor:
        raise ValueError(f"unknown similarity {kind!r}")
    return F.when(divisor[kind] > 0, (2 if kind == "dice" else 1) * c / divisor[kind]).otherwise(0.0)


def similarity(graph: Graph, starts: DataFrame, pool: DataFrame, kind: str = "hpi") -> DataFrame:
    """start, id, sim for every start and node of the pool; 1 with itself, 0 where a degree is 0."""
    deg = graph.strength().select("id", "degree")
    pairs = starts.select("start").crossJoin(pool.select("id"))  # the result's own size: few starts
    common = common_neighbours(graph, starts)
    rows = pairs.join(common, ["start", "id"], "left").join(deg.select("id", F.col("degree").alias("k_id")), "id").join(deg.select(F.col("id").alias("start"), F.col("degree").alias("k_start")), "start")
    rows = rows.withColumn("common", F.coalesce("common", F.lit(0)))
    return rows.select("start", "id", F.when(F.col("start") == F.col("id"), 1.0).otherwise(_measure(kind)).alias("sim"))


def candidates_max(scores: DataFrame, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows near the greatest score: score >= max - alpha (max - min)."""
    a = min(max(alpha, 0.0), 1.0)
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("_at", hi - a * (hi - lo)).where(F.col("score") >= F.col("_at")).drop("_at")


def candidates_floor(scores: DataFrame, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows above a floor: score >= min + alpha (max - min); with equal scores all of them."""
    a = min(max(alpha, 0.0), 1.0)
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("_at", lo + a * (hi - lo)).where(F.col("score") >= F.col("_at")).drop("_at")


def fill_non_finite(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """NaN, infinite and null scores become the least finite one of their group, or 0."""
    s = F.col("score")
    fine = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return scores.withColumn("score", F.when(fine, s).otherwise(F.coalesce(F.min(F.when(fine, s)).over(w), F.lit(0.0))))
