"""Agreement of two partitions of the same nodes, from their contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

By = tuple[str, ...]


def contingency(a: DataFrame, b: DataFrame, by: By = ()) -> DataFrame:
    """by, x, y, n from two tables (by, id, x) and (by, id, y)."""
    return a.join(b, [*by, "id"]).groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def _marginals(table: DataFrame, by: By) -> tuple[DataFrame, DataFrame]:
    return table.groupBy(*by, "x").agg(F.sum("n").alias("n")), table.groupBy(*by, "y").agg(F.sum("n").alias("n"))


def _nlogn(n: Column) -> Column:
    return F.sum(n * F.ln(n.cast("double")))


def agreement(table: DataFrame, by: By = ()) -> DataFrame:
    """by, n, nmi, ari, rand, vi, split_join.

    Two partitions without entropy agree fully (nmi 1); where the adjusted
    index has no range it is null.
    """
    rows, cols = _marginals(table, by)
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n")
    t = table.groupBy(*by).agg(F.sum("n").alias("n"), _nlogn(n).alias("l"), F.sum(pairs(n)).alias("p"))
    x = rows.groupBy(*by).agg(_nlogn(n).alias("lx"), F.sum(pairs(n)).alias("px"))
    y = cols.groupBy(*by).agg(_nlogn(n).alias("ly"), F.sum(pairs(n)).alias("py"))
    best_x = table.groupBy(*by, "x").agg(F.max("n").alias("m")).groupBy(*by).agg(F.sum("m").alias("mx"))
    best_y = table.groupBy(*by, "y").agg(F.max("n").alias("m")).groupBy(*by).agg(F.sum("m").alias("my"))
    wide = t
    for part in (x, y, best_x, best_y):
        wide = wide.join(part, list(by)) if by else wide.crossJoin(part)  # one row each
    big, all_ = F.col("n").cast("double"), pairs(F.col("n"))
    hx, hy = F.ln(big) - F.col("lx") / big, F.ln(big) - F.col("ly") / big
    joint = F.ln(big) - F.col("l") / big
    mutual = hx + hy - joint
    mean, chance = (F.col("px") + F.col("py")) / 2, F.col("px") * F.col("py") / all_
    flat = F.abs(hx + hy) < 1e-12
    return wide.select(
        *by,
        "n",
        F.when(flat, 1.0).otherwise(2 * mutual / F.when(flat, 1.0).otherwise(hx + hy)).alias("nmi"),
        F.when(F.abs(mean - chance) > 1e-12, (F.col("p") - chance) / F.when(F.abs(mean - chance) > 1e-12, mean - chance).otherwise(1.0)).alias("ari"),
        ((all_ + 2 * F.col("p") - F.col("px") - F.col("py")) / all_).alias("rand"),
        (2 * joint - hx - hy).alias("vi"),
        (2 * F.col("n") - F.col("mx") - F.col("my")).alias("split_join"),
    )


def purity(table: DataFrame, by: By = ()) -> DataFrame:
    """by, y, size, dominant, purity: the most frequent x of each y, least x on ties."""
    w = W.partitionBy(*by, "y")
    first = table.withColumn("size", F.sum("n").over(w)).withColumn("_at", F.row_number().over(w.orderBy(F.desc("n"), "x"))).where("_at = 1")
    return first.select(*by, "y", "size", F.col("x").alias("dominant"), (F.col("n") / F.col("size")).alias("purity"))


def pairwise_nmi(pool: DataFrame) -> DataFrame:
    """i, j, nmi for all pairs i < j of partitions (iter, id, community)."""
    a = pool.select(F.col("iter").alias("i"), "id", F.col("community").alias("x"))
    b = pool.select(F.col("iter").alias("j"), "id", F.col("community").alias("y"))
    table = a.join(b, "id").where("i < j").groupBy("i", "j", "x", "y").agg(F.count("*").alias("n"))
    return agreement(table, ("i", "j")).select("i", "j", "nmi")
