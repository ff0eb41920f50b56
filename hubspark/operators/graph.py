"""Undirected graphs as two tables: nodes(id, ...) and edges(src < dst, w), one row per edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder; one is set only where none is configured."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def adj(self) -> DataFrame:
        """Both orientations of every edge."""
        return self.edges.select("src", "dst", "w").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def strength(self) -> DataFrame:
        """(id, degree, strength) of every node, isolates included."""
        per = self.adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
        return self.nodes.select("id").join(per, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph on a table of ids: semi-joins at both ends."""
        keep = ids.select("id").distinct()
        e = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(keep, "id", "left_semi"), e.select("src", "dst", "w"))


def canonical(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """Loops dropped, orientations merged; weights of repeated edges add up, without weights each edge weighs 1."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *(["w"] if weighted else []))
    if not weighted:
        return e.distinct().withColumn("w", F.lit(1.0))
    return e.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))


def check_weights(edges: DataFrame) -> None:
    """Raises unless all weights are finite and not negative."""
    bad = edges.where("w is null or isnan(w) or w < 0 or w = double('Infinity')").limit(1).count()
    if bad:
        raise ValueError("edge weights must be finite and >= 0")


def from_edge_list(edges: DataFrame, n: int | None = None, weighted: bool = False) -> Graph:
    """Nodes 1..n (default: the largest id), so isolates are padded."""
    spark = edges.sparkSession
    if n is None:
        n = edges.select(F.max(F.greatest("src", "dst")).alias("n")).first()["n"] or 0
    return Graph(spark.range(1, n + 1), canonical(edges, weighted))


def from_adjacency(rows: DataFrame, weighted: bool = False) -> Graph:
    """From (id, values ARRAY): row i of a symmetric matrix. The diagonal is ignored; values act as multiplicities unless ``weighted``."""
    cells = rows.select(F.col("id").alias("src"), F.posexplode("values").alias("pos", "w")).where("w <> 0").select("src", (F.col("pos") + 1).cast("bigint").alias("dst"), F.col("w").cast("double").alias("w"))
    upper = cells.where("src < dst")
    edges = upper if weighted else upper.withColumn("w", F.lit(1.0))
    return Graph(rows.select("id"), edges)


def cooccurrence(rows: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """Edges between items of the same groups; w counts the groups they share.

    Each group is deduplicated first; the self-join is on the group key, so it
    is as large as the sum of squared group sizes and no larger.
    """
    a = rows.select(F.col(group).alias("g"), F.col(item).cast("bigint").alias("src")).distinct()
    b = a.withColumnRenamed("src", "dst")
    return a.join(b, "g").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")).where(F.col("w") >= least)


def components(graph: Graph) -> DataFrame:
    """(id, component): least reachable id, by label propagation with shortcuts, checkpointed each round."""
    labels = cut(graph.nodes.select("id", F.col("id").alias("component")))
    while True:
        near = graph.adj.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        least = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("next"))
        # shortcut: the label of the label
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("up"))
        after = cut(least.join(jump, "next").select("id", "component", F.least("next", "up").alias("new")))
        moved = after.where("new <> component").limit(1).count()
        labels = after.select("id", F.col("new").alias("component"))
        if not moved:
            return labels


def largest_component(graph: Graph) -> Graph:
    """The component of most nodes; of equally large ones that with the least id."""
    comps = components(graph)
    top = comps.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return graph.induced(comps.join(top, "component", "left_semi"))


def names(nodes: DataFrame) -> Column:
    """Display name: the name, else the id."""
    return F.coalesce(F.col("name"), F.col("id").cast("string")) if "name" in nodes.columns else F.col("id").cast("string")


MEMBERSHIP = T.StructType([T.StructField("iter", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("community", T.IntegerType())])
