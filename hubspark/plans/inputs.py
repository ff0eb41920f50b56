"""Graphs, partitions, leaders and traces derived from the driver's tables, in Spark and as SQL views.

Everything is deterministic: partitions come from columns or from id arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.graph import Graph, cooccurrence, cut


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("truth"), F.col("p_retailprice").alias("score"))


def parts(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Parts bought in the same order; w counts the orders they share.

    Every score reads the edges several times, so the self-join is run once and its result checkpointed.
    """
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return Graph(nodes(spark, sf_dir), cut(cooccurrence(rows, "l_orderkey", "l_partkey", least)))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, community): the dense rank of the part's brand."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    from pyspark.sql import Window as W

    ids = p.select("p_brand").distinct().withColumn("community", F.row_number().over(W.orderBy("p_brand")))  # 25 rows
    return p.join(F.broadcast(ids), "p_brand").select(F.col("p_partkey").alias("id"), "community")


POOL = 8


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iter, id, community): POOL partitions by id arithmetic."""
    iters = spark.range(1, POOL + 1).select(F.col("id").cast("int").alias("iter"))
    return nodes(spark, sf_dir).select("id").crossJoin(F.broadcast(iters)).select("iter", "id", (F.pmod(F.col("id") * (2 * F.col("iter") + 1) + F.col("iter"), F.lit(5) + F.col("iter") % 3) + 1).cast("int").alias("community"))  # 8 rows


def pool_leaders(g: Graph, p: DataFrame) -> DataFrame:
    return quality.top_degree_leaders(g, p, ("iter",))


def trace(g: Graph, p: DataFrame) -> DataFrame:
    """(iter, k, q, h) of the pool's partitions, rounded so that comparisons are the same everywhere."""
    q = quality.modularity(g, p, ("iter",)).select("iter", F.round("q", 9).alias("q"))
    h = quality.entropy_global(g, pool_leaders(g, p), ("iter",)).select("iter", F.round("h", 9).alias("h"))
    return q.join(h, "iter").select("iter", (F.col("iter") % 3).cast("int").alias("k"), "q", "h")


def prelude(least: int = 2) -> str:
    """The same as SQL: WITH and the common table expressions, without what follows."""
    return f"""WITH RECURSIVE items AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, l_partkey AS p FROM lineitem),
nodes AS (SELECT p_partkey AS id, p_name AS name, p_type AS truth, p_retailprice AS score FROM part),
edges AS MATERIALIZED (SELECT a.p AS src, b.p AS dst, count(*)::DOUBLE AS w FROM items a JOIN items b ON a.g = b.g AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= {least}),
adj AS MATERIALIZED (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges),
strength AS MATERIALIZED (SELECT n.id, count(a.dst) AS degree, coalesce(sum(a.w), 0) AS strength FROM nodes n LEFT JOIN adj a ON a.src = n.id GROUP BY 1),
m AS MATERIALIZED (SELECT p_partkey AS id, dense_rank() OVER (ORDER BY p_brand)::INT AS community FROM part),
ends AS MATERIALIZED (SELECT a.src, a.dst, a.w, x.community AS cs, y.community AS cd FROM adj a JOIN m x ON x.id = a.src JOIN m y ON y.id = a.dst),
sums AS (SELECT v.community, v.size, v.vol, coalesce(i.intra, 0) AS intra, (SELECT sum(strength) FROM strength) AS two_w
  FROM (SELECT community, count(*) AS size, sum(strength) AS vol FROM m JOIN strength USING (id) GROUP BY 1) v
  LEFT JOIN (SELECT cs AS community, sum(w) AS intra FROM ends WHERE cs = cd GROUP BY 1) i USING (community)),
leaders AS (SELECT community, arg_max(id, (strength, -id)) AS leader FROM m JOIN strength USING (id) GROUP BY 1),
pool AS (SELECT t.iter::INT AS iter, id, (((id * (2 * t.iter + 1) + t.iter) % (5 + t.iter % 3)) + 1)::INT AS community FROM nodes, (SELECT unnest(range(1, {POOL + 1})) AS iter) t),
pool_ends AS (SELECT x.iter, a.src, a.dst, a.w, x.community AS cs, y.community AS cd FROM adj a JOIN pool x ON x.id = a.src JOIN pool y ON y.id = a.dst AND y.iter = x.iter),
pool_sums AS (SELECT v.iter, v.community, v.vol, coalesce(i.intra, 0) AS intra, (SELECT sum(strength) FROM strength) AS two_w
  FROM (SELECT iter, community, sum(strength) AS vol FROM pool JOIN strength USING (id) GROUP BY 1, 2) v
  LEFT JOIN (SELECT iter, cs AS community, sum(w) AS intra FROM pool_ends WHERE cs = cd GROUP BY 1, 2) i ON i.iter = v.iter AND i.community = v.community),
pool_q AS (SELECT iter, round(sum(intra) / max(two_w) - sum(vol * vol) / (max(two_w) * max(two_w)), 9) AS q FROM pool_sums GROUP BY 1),
pool_leaders AS (SELECT iter, community, arg_max(id, (strength, -id)) AS leader FROM pool JOIN strength USING (id) GROUP BY 1, 2),
n_all AS (SELECT count(*)::DOUBLE AS n FROM nodes),
node_h AS (SELECT id, degree, CASE WHEN degree > 0 AND degree < n THEN -(degree / n * log2(degree / n) + (1 - degree / n) * log2(1 - degree / n)) ELSE (1 + log2(n)) / n END AS h,
  CASE WHEN degree > 0 AND degree < n THEN -(degree / n * log2(degree / n) + (1 - degree / n) * log2(1 - degree / n)) ELSE 0 END AS h0 FROM strength, n_all),
trace AS (SELECT q.iter, (q.iter % 3)::INT AS k, q.q, round(avg(h.h), 9) AS h FROM pool_q q JOIN pool_leaders l ON l.iter = q.iter JOIN node_h h ON h.id = l.leader GROUP BY ALL),
sizes AS (SELECT community, count(*) AS size FROM m GROUP BY 1),
links AS (SELECT l.community, l.leader, s.size, coalesce(i.inner_, 0) AS inner_ FROM leaders l JOIN sizes s USING (community)
  LEFT JOIN (SELECT src, count(*) AS inner_ FROM ends WHERE cs = cd GROUP BY 1) i ON i.src = l.leader),
part_ AS (SELECT n.id, coalesce(p.participation, 0) AS participation FROM nodes n LEFT JOIN
  (SELECT src AS id, 1 - sum(k * k) / (sum(k) * sum(k)) AS participation FROM (SELECT src, cd, sum(w) AS k FROM ends GROUP BY 1, 2) GROUP BY 1) p USING (id)),
cells AS (SELECT truth AS x, community AS y, count(*) AS n FROM nodes JOIN m USING (id) GROUP BY 1, 2)
"""
