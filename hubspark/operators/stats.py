"""Rank and permutation tests, group letters, designs and least squares."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import coin


def mid_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank``: mean rank among equal values.

    Only the counts of distinct values are numbered in order, not the rows.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_t"))
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(value)
    at = counts.withColumn("rank", F.sum("_t").over(w) - (F.col("_t") - 1) / 2)
    return df.join(at.select(*by, value, "rank"), [*by, value])


def kruskal(df: DataFrame, group: str = "group", value: str = "value") -> DataFrame:
    """One row: h (corrected for ties), df, n; h is null for constant values."""
    ranked = mid_ranks(df, value)
    per = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("m"))
    total = per.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("n"), (F.count("*") - 1).alias("df"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    keep = 1 - F.col("ties") / (n * n * n - n)
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return total.crossJoin(F.broadcast(ties)).select(F.when(keep > 0, raw / F.when(keep > 0, keep).otherwise(1.0)).alias("h"), "df", "n")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        f *= (step := c * d)
        if abs(step - 1) < 1e-15:
            break
    return scale * f


def permutation_test(df: DataFrame, b: int, seed: int = 1, group: str = "group", value: str = "value") -> DataFrame:
    """One row: diff, p of the two-sided difference of means of the groups x and y over ``b`` shuffles.

    Rows need ``key``: each shuffle ranks them by a hash of shuffle and key, and
    the first ones are x. p = (as extreme + 1) / (b + 1); 1 without variance, null for a group under two.
    """
    spark = df.sparkSession
    sums = df.agg(F.count_if(F.col(group) == "x").alias("nx"), F.count_if(F.col(group) == "y").alias("ny"), F.sum(value).alias("s"), F.avg(F.when(F.col(group) == "x", F.col(value))).alias("mx"), F.avg(F.when(F.col(group) == "y", F.col(value))).alias("my"), (F.max(value) - F.min(value)).alias("range"))
    shuffles = spark.range(1, b + 1).select(F.col("id").alias("perm"))
    dealt = df.select("key", value).crossJoin(F.broadcast(shuffles)).withColumn("_at", F.row_number().over(W.partitionBy("perm").orderBy(coin(seed, "perm", "key"), "key")))
    first = dealt.join(F.broadcast(sums.select("nx"))).where(F.col("_at") <= F.col("nx")).groupBy("perm").agg(F.sum(value).alias("sx"))
    diffs = first.crossJoin(F.broadcast(sums)).select("nx", "ny", "range", (F.col("mx") - F.col("my")).alias("diff"), (F.col("sx") / F.col("nx") - (F.col("s") - F.col("sx")) / F.col("ny")).alias("d"))
    extreme = F.count_if(F.abs("d") >= F.abs("diff") - 1e-9)
    p = F.when((F.max("nx") < 2) | (F.max("ny") < 2), None).when(F.max("range") == 0, 1.0).otherwise((extreme + 1) / (b + 1))
    return diffs.agg(F.max("diff").alias("diff"), p.alias("p"))


#: There are so many letters.
MAX_GROUPS = 52


def letters(groups: list[str], p: dict[tuple[str, str], float], alpha: float = 0.05, strict: bool = False) -> dict[str, str]:
    """Compact letters: groups that do not differ share one.

    A group joins the first letter whose last member it does not differ from;
    so 1~2, 2~3 with 1 and 3 different still share one. ``strict`` compares with all members.
    """
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"at most {MAX_GROUPS} groups")
    differ = lambda a, b: p.get((a, b), p.get((b, a), 1.0)) <= alpha
    sets: list[list[str]] = []
    for g in groups:
        for s in sets:
            if not any(differ(g, x) for x in (s if strict else s[-1:])):
                s.append(g)
                break
        else:
            sets.append([g])
    names = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {g: "".join(names[i] for i, s in enumerate(sets) if g in s) for g in groups}


@dataclass(frozen=True)
class GroupTest:
    h: float | None
    p: float
    rejected: bool
    pairs: dict[tuple[str, str], float]
    letters: dict[str, str]


def kruskal_then_permute(df: DataFrame, b: int = 10_000, alpha: float = 0.05, seed: int = 1) -> GroupTest:
    """Rank test over (key, group, value); if it rejects, all pairs by permutation with Bonferroni's correction."""
    groups = [r["group"] for r in df.select("group").distinct().orderBy("group").limit(MAX_GROUPS + 1).collect()]
    if not 2 <= len(groups) <= MAX_GROUPS:
        raise ValueError(f"from two to {MAX_GROUPS} groups are needed")
    row = kruskal(df).first()
    p = 1.0 if row["h"] is None else chi2_tail(row["h"], row["df"])
    if p > alpha:
        return GroupTest(row["h"], p, False, {}, dict.fromkeys(groups, "a"))
    names = [(x, y) for i, x in enumerate(groups) for y in groups[i + 1 :]]
    pairs = {}
    for x, y in names:
        two = df.where(F.col("group").isin(x, y)).withColumn("group", F.when(F.col("group") == x, "x").otherwise("y"))
        pairs[x, y] = min(1.0, (permutation_test(two, b, seed).first()["p"] or 1.0) * len(names))
    means = {r["group"]: r["m"] for r in df.groupBy("group").agg(F.avg("value").alias("m")).collect()}
    return GroupTest(row["h"], p, True, pairs, letters(sorted(groups, key=lambda g: (-means[g], g)), pairs, alpha))


def rank_sum(df: DataFrame, group: str = "group", value: str = "value") -> DataFrame:
    """One row: u of group x and z of its normal approximation, corrected for ties."""
    ranked = mid_ranks(df, value)
    s = ranked.agg(F.sum(F.when(F.col(group) == "x", F.col("rank"))).alias("r"), F.count_if(F.col(group) == "x").cast("double").alias("nx"), F.count_if(F.col(group) == "y").cast("double").alias("ny"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, nx, ny = F.col("nx") + F.col("ny"), F.col("nx"), F.col("ny")
    u = F.col("r") - nx * (nx + 1) / 2
    sd = F.sqrt(nx * ny / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.crossJoin(F.broadcast(ties)).select(u.alias("u"), ((u - nx * ny / 2) / sd).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    a = mid_ranks(df, x).withColumnRenamed("rank", "_rx")
    return mid_ranks(a, y).agg(F.corr("_rx", "rank").alias("rho"))


def normal_equations(df: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n (an intercept first), summed in one pass; the size is that of the model."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    y = F.col(target).cast("double")
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]
    r = df.agg(*sums, F.sum(y * y).alias("yy"), F.count("*").alias("n")).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return a, np.array([r[f"b{i}"] for i in range(k)]), r["yy"], r["n"]


def least_squares(df: DataFrame, columns: list[str], target: str) -> dict[str, dict[str, float]]:
    """Estimate, standard error and t of each column and the intercept."""
    a, b, yy, n = normal_equations(df, columns, target)
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    spare = max(n - len(b), 1)
    s2 = max(yy - beta @ b, 0.0) / spare
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    return {c: {"estimate": float(e), "se": float(s), "t": float(e / s) if s > 0 else float("inf")} for c, e, s in zip(["intercept", *columns], beta, se, strict=True)}


def anova(df: DataFrame, group: str = "group", value: str = "value") -> DataFrame:
    """One row: between, within (sums of squares), df1, df2 and f of a one-way analysis of variance; f is null without variance inside groups."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, s, q, k = F.sum("n"), F.sum("s"), F.sum("q"), F.count("*")
    means = F.sum(F.col("s") * F.col("s") / F.col("n"))
    row = per.agg((means - s * s / n).alias("between"), (q - means).alias("within"), (k - 1).alias("df1"), (n - k).alias("df2"))
    ratio = (F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2"))
    return row.withColumn("f", F.when((F.col("within") > 0) & (F.col("df1") > 0) & (F.col("df2") > 0), ratio))


def bonferroni(p: str, n: int) -> Column:
    """p values of ``n`` tests, corrected."""
    return F.least(F.lit(1.0), F.col(p) * n)


def effect_table(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """term, estimate, se, t of a least-squares fit, greatest |t| first: one row per term of the model."""
    fit = least_squares(df, columns, target)
    rows = [(name, v["estimate"], v["se"], v["t"]) for name, v in fit.items()]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double").orderBy(F.abs("t").desc(), "term")


def stationary_point(df: DataFrame, columns: list[str], target: str) -> dict:
    """Second-order response surface: point -B^-1 b / 2 and the eigenvalues of B."""
    wide, names = df, list(columns)
    for i, c in enumerate(columns):
        for d in columns[i:]:
            wide = wide.withColumn(f"{c}:{d}", F.col(c) * F.col(d))
            names.append(f"{c}:{d}")
    fit = {k: v["estimate"] for k, v in least_squares(wide, names, target).items()}
    k = len(columns)
    b = np.array([fit[c] for c in columns])
    m = np.array([[fit[f"{columns[min(i, j)]}:{columns[max(i, j)]}"] / (1 if i == j else 2) for j in range(k)] for i in range(k)])
    return {"point": dict(zip(columns, (-0.5 * np.linalg.solve(m, b)).tolist(), strict=True)), "eigenvalues": np.linalg.eigvalsh(m).tolist(), "fit": fit}


def factorial(spark, levels: dict[str, list[float]], reps: int, seed: int = 1) -> DataFrame:
    """Full factorial design with ``row`` and a seed per row: the product of the levels is the result's own size."""
    out = spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))
    for name, values in levels.items():
        out = out.crossJoin(F.broadcast(spark.createDataFrame([(float(v),) for v in values], f"{name} double")))
    w = W.partitionBy(F.lit(0)).orderBy(*levels, "rep")
    return out.withColumn("row", F.row_number().over(w)).withColumn("seed", F.lit(seed) + F.col("row"))


def composite(spark, factors: list[str], centres: int = 1) -> DataFrame:
    """Rotatable central composite design in coded units: corners, axes and centre points."""
    k = len(factors)
    a = 2 ** (k / 4)
    corners = [[1.0 if i >> j & 1 else -1.0 for j in range(k)] for i in range(2**k)]
    axes = [[s * a if i == j else 0.0 for j in range(k)] for i in range(k) for s in (-1, 1)]
    rows = [(kind, *r) for kind, part in (("corner", corners), ("axis", axes), ("centre", [[0.0] * k] * centres)) for r in part]
    return spark.createDataFrame(rows, "kind string, " + ", ".join(f"{f} double" for f in factors))


def actual(coded, lo: float, hi: float):
    """Coded units to a range, clamped to it."""
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    return F.greatest(F.lit(lo), F.least(F.lit(hi), mid + half * coded))
