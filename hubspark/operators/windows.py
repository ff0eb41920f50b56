"""Ranks, running values and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_in(group: str, score: str) -> Column:
    """1 + number of peers with a greater score."""
    return F.rank().over(W.partitionBy(group).orderBy(F.desc(score)))


def percentile_in(group: str, score: str) -> Column:
    """Share of peers with a score no greater; 1 if alone."""
    return F.cume_dist().over(W.partitionBy(group).orderBy(F.asc(score)))


def running_max(value: str, order: str, by: tuple[str, ...] = ()) -> Column:
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(order)
    return F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))


def renumber(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Communities as 1, 2, ... in the order of their ids. Only the distinct ids are ranked."""
    ids = m.select(*by, "community").distinct()
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("community")
    dense = ids.withColumn("dense", F.row_number().over(w))
    return m.join(dense, [*by, "community"]).select(*by, "id", F.col("dense").alias("community"))


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int, ties: bool = False) -> DataFrame:
    """The k rows of greatest score per group; with ``ties`` also those as good as the k-th."""
    w = W.partitionBy(by).orderBy(F.desc(score), *([] if ties else [F.asc(tie)]))
    return df.withColumn("place", (F.rank() if ties else F.row_number()).over(w)).where(F.col("place") <= k)


def min_max(value: str, by: str) -> Column:
    w = W.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (F.col(value) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)).otherwise(0.0)


def dominates(q1: Column, h1: Column, q0: Column, h0: Column, tol: float = 1e-12) -> Column:
    """Better Q by ``tol``, or as good a Q and better H by ``tol``."""
    return (q1 > q0 + tol) | ((F.abs(q1 - q0) <= tol) & (h1 > h0 + tol))


def incumbent(trace: DataFrame, by: tuple[str, ...] = (), tol: float = 1e-12) -> DataFrame:
    """by, best_iter, q, h, decisive: the row that stands after an ordered pass, and how often H decided.

    The comparison has a tolerance, so the result depends on the order and is a fold, not a maximum.
    """
    rows = F.array_sort(F.collect_list(F.struct("iter", "q", "h")))

    def step(a: Column, r: Column) -> Column:
        first = a["iter"].isNull()
        won = first | dominates(r["q"], r["h"], a["q"], a["h"], tol)
        by_h = ~first & (F.abs(r["q"] - a["q"]) < tol) & (F.abs(r["h"] - a["h"]) > tol)
        pick = lambda x: F.when(won, r[x]).otherwise(a[x]).alias(x)
        return F.struct(pick("iter"), pick("q"), pick("h"), (a["decisive"] + F.when(by_h, 1).otherwise(0)).alias("decisive"))

    start = F.struct(F.lit(None).cast("int").alias("iter"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("h"), F.lit(0).alias("decisive"))
    fold = trace.withColumn("iter", F.col("iter").cast("int")).groupBy(*by).agg(F.aggregate(rows, start, step).alias("b"))
    return fold.select(*by, F.col("b.iter").alias("best_iter"), "b.q", "b.h", "b.decisive")
