"""Readers of graph files into nodes and edges."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, canonical

#: Zachary's karate club (1977), each edge once, by lesser node.
KARATE = {
    1: (2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32), 2: (3, 4, 8, 14, 18, 20, 22, 31), 3: (4, 8, 9, 10, 14, 28, 29, 33), 4: (8, 13, 14), 5: (7, 11), 6: (7, 11, 17), 7: (17,), 9: (31, 33, 34),
    10: (34,), 14: (34,), 15: (33, 34), 16: (33, 34), 19: (33, 34), 20: (34,), 21: (33, 34), 23: (33, 34), 24: (26, 28, 30, 33, 34), 25: (26, 28, 32), 26: (32,), 27: (30, 34), 28: (34,), 29: (32, 34),
    30: (33, 34), 31: (33, 34), 32: (33, 34), 33: (34,),
}


def karate(spark: SparkSession) -> Graph:
    edges = [(a, b, 1.0) for a, near in KARATE.items() for b in near]
    return Graph(spark.range(1, 35), spark.createDataFrame(edges, "src long, dst long, w double"))


def read_gml(spark: SparkSession, path: str) -> Graph:
    """Nodes (id from 1 in file order, name, truth) and undirected, simplified edges of a GML file."""
    text = spark.read.text(path, wholetext=True)
    blocks = lambda kind: F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1))
    field = lambda pattern: F.nullif(F.regexp_extract("b", pattern, 1), F.lit(""))
    raw = text.select(F.posexplode(blocks("node")).alias("at", "b")).select(
        (F.col("at") + 1).cast("bigint").alias("id"), field(r"\bid\s+(-?\d+)").alias("_file"), field(r'\blabel\s+"([^"]*)"').alias("name"), field(r'\bvalue\s+"?([^"\s]+)').alias("truth")
    )
    ends = text.select(F.explode(blocks("edge")).alias("b")).select(field(r"\bsource\s+(-?\d+)").alias("_s"), field(r"\btarget\s+(-?\d+)").alias("_t"))
    a, b = raw.select(F.col("id").alias("src"), F.col("_file").alias("_s")), raw.select(F.col("id").alias("dst"), F.col("_file").alias("_t"))
    return Graph(raw.drop("_file"), canonical(ends.join(a, "_s").join(b, "_t").select("src", "dst"), weighted=False))


def read_edge_list(spark: SparkSession, edges: str, truth: str | None = None, n: int | None = None) -> Graph:
    """Lines "u v" from 1; a truth file has one label per line in the order of nodes."""
    e = spark.read.csv(edges, sep=" ", schema="src long, dst long")
    if truth is None:
        top = n or e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return Graph(spark.range(1, top + 1), canonical(e, weighted=False))
    lines = spark.read.text(truth, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("at", "truth"))
    return Graph(lines.select((F.col("at") + 1).cast("bigint").alias("id"), "truth"), canonical(e, weighted=False))


def read_npz(spark: SparkSession, path: str) -> Graph:
    """A CSR adjacency in an NPZ file (adj_data, adj_indices, adj_indptr, labels); weights of both orientations become the greater."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                z = np.load(io.BytesIO(blob), allow_pickle=False)
                rows = np.repeat(np.arange(len(z["adj_indptr"]) - 1), np.diff(z["adj_indptr"]))
                yield pd.DataFrame({"src": rows + 1, "dst": z["adj_indices"] + 1, "w": z["adj_data"].astype(float), "truth": None})
                if "labels" in z:
                    yield pd.DataFrame({"src": np.arange(len(z["labels"])) + 1, "dst": 0, "w": 0.0, "truth": z["labels"].astype(str)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "src long, dst long, w double, truth string")
    both = rows.where("dst > 0 and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    nodes = rows.where("dst = 0").select(F.col("src").alias("id"), "truth")
    return Graph(nodes, both.groupBy("src", "dst").agg(F.max("w").alias("w")))


def coauthors(works: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """From works (work, authors ARRAY, cited): authors with at least ``least`` works as (id, name, cited, works), and their joint works as edges."""
    flat = works.select("work", "cited", F.explode(F.array_distinct("authors")).alias("name")).where("name is not null")
    people = flat.groupBy("name").agg(F.sum("cited").alias("cited"), F.count("*").alias("works")).where(F.col("works") >= least)
    from pyspark.sql import Window as W

    people = people.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("name")).cast("bigint").alias("id"), "name", "cited", "works")
    kept = flat.join(people.select("name", "id"), "name").select("work", "id")
    a, b = kept.withColumnRenamed("id", "src"), kept.withColumnRenamed("id", "dst")
    edges = a.join(b, "work").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return people, edges


def random_blocks(spark: SparkSession, sizes: list[int], inside: float, between: float, seed: int = 1) -> Graph:
    """Planted partition: each pair is an edge with the chance of its blocks, by a coin of the pair."""
    from ..functions.rng import coin

    bounds, total = [], 0
    for s in sizes:
        total += s
        bounds.append(total)
    block = lambda c: sum(((F.col(c) > b).cast("int") for b in bounds), F.lit(1))
    nodes = spark.range(1, total + 1)
    a, b = nodes.withColumnRenamed("id", "src").withColumn("a", block("src")), nodes.withColumnRenamed("id", "dst").withColumn("b", block("dst"))
    chance = F.when(F.col("a") == F.col("b"), int(inside * 2**32)).otherwise(int(between * 2**32))
    edges = a.join(b, F.col("src") < F.col("dst")).where(coin(seed, "src", "dst") < chance)
    return Graph(nodes.select("id", block("id").cast("string").alias("truth")), edges.select("src", "dst", F.lit(1.0).alias("w")))


def informative_weights(edges: DataFrame, truth: DataFrame, seed: int = 1) -> DataFrame:
    """Weights from U(1.5, 4) within a block and U(0.1, 1) between blocks."""
    from ..functions.rng import uniform

    e = edges.join(truth.select(F.col("id").alias("src"), F.col("truth").alias("a")), "src").join(truth.select(F.col("id").alias("dst"), F.col("truth").alias("b")), "dst")
    u = uniform(seed, "src", "dst")
    return e.select("src", "dst", F.when(F.col("a") == F.col("b"), 1.5 + 2.5 * u).otherwise(0.1 + 0.9 * u).alias("w"))
