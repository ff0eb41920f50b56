"""Tables behind the figures, and a plain SVG of a partition."""

from __future__ import annotations

import colorsys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import collect
from ..functions.rng import uniform_of
from .graph import Graph, names
from .windows import running_max


def palette(n: int) -> list[str]:
    """n colours evenly around the hue circle."""
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hls_to_rgb(i / max(n, 1), 0.55, 0.6)) for i in range(n)]


#: The layout holds all distances at once: 16 bytes for each two nodes.
MAX_DRAWN = 5_000


def layout(graph: Graph, steps: int = 60, seed: int = 1) -> dict[int, tuple[float, float]]:
    """Force-directed places on the unit square, for graphs small enough to draw."""
    if graph.nodes.limit(MAX_DRAWN + 1).count() > MAX_DRAWN:
        raise ValueError(f"at most {MAX_DRAWN} nodes can be drawn; take a subgraph")
    g = collect(graph, 200_000)
    n = g.n
    xy = np.array([[uniform_of(seed, "x", int(i)), uniform_of(seed, "y", int(i))] for i in g.ids])
    ideal = 1 / np.sqrt(max(n, 1))
    for step in range(steps):
        gap = xy[:, None, :] - xy[None, :, :]
        far = np.maximum(np.sqrt((gap**2).sum(-1)), 1e-6)
        force = (gap / far[..., None] * (ideal**2 / far)[..., None]).sum(1)
        pull = xy[g.src] - xy[g.dst]
        pull *= np.sqrt((pull**2).sum(-1, keepdims=True)) / ideal
        np.add.at(force, g.src, -pull)
        size = np.maximum(np.sqrt((force**2).sum(-1, keepdims=True)), 1e-9)
        xy += force / size * np.minimum(size, 0.1 * (1 - step / steps))
    xy -= xy.min(0)
    xy /= np.maximum(xy.max(0), 1e-9)
    return {int(i): (float(x), float(y)) for i, (x, y) in zip(g.ids, xy, strict=True)}


def plot_frames(graph: Graph, m: DataFrame, leaders: DataFrame, seed: int = 1, legend_max: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, x, y, community, is_leader, label, color), edges(x, y, xend, yend, intra), legend(label, color)."""
    spark = graph.nodes.sparkSession
    places = spark.createDataFrame([(i, x, y) for i, (x, y) in layout(graph, seed=seed).items()], "id long, x double, y double")
    groups = [r["community"] for r in m.select("community").distinct().orderBy("community").collect()]
    colours = dict(zip(groups, palette(len(groups)), strict=True))
    colour = spark.createDataFrame([(int(c), x) for c, x in colours.items()], "community int, color string")
    lead = leaders.select(F.col("leader").alias("id"), F.lit(True).alias("is_leader")).distinct()
    label = graph.nodes.select("id", names(graph.nodes).alias("name"))
    nodes = m.join(places, "id").join(colour, "community").join(lead, "id", "left").join(label, "id").select("id", "x", "y", "community", F.coalesce("is_leader", F.lit(False)).alias("is_leader"), F.when(F.col("is_leader"), F.col("name")).alias("label"), "color")
    a = nodes.select(F.col("id").alias("src"), "x", "y", F.col("community").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("xend"), F.col("y").alias("yend"), F.col("community").alias("b"))
    edges = graph.edges.join(a, "src").join(b, "dst").select("x", "y", "xend", "yend", (F.col("a") == F.col("b")).alias("intra"))
    shown = [(f"community {c}", colours[c]) for c in groups[:legend_max]]
    if len(groups) > legend_max:
        shown.append((f"+{len(groups) - legend_max} more", "#888888"))
    return nodes, edges, spark.createDataFrame(shown, "label string, color string")


def svg(nodes: DataFrame, edges: DataFrame, size: int = 600) -> str:
    """A picture of the frames."""
    at = lambda v: f"{10 + v * (size - 20):.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">']
    out += [f'<line x1="{at(e.x)}" y1="{at(e.y)}" x2="{at(e.xend)}" y2="{at(e.yend)}" stroke="{"#777" if e.intra else "#ddd"}"/>' for e in edges.collect()]
    out += [f'<circle cx="{at(v.x)}" cy="{at(v.y)}" r="{7 if v.is_leader else 4}" fill="{v.color}"><title>{v.id}</title></circle>' for v in nodes.collect()]
    return "\n".join([*out, "</svg>"])


def trajectory(trace: DataFrame) -> DataFrame:
    """iter, q, q_running_max."""
    return trace.select("iter", "q", running_max("q", "iter").alias("q_running_max"))


def probabilities(history: DataFrame) -> DataFrame:
    """Wide: a row per iteration, a column per parameter pair."""
    ks = [r["k"] for r in history.select("k").distinct().orderBy("k").collect()]
    return history.groupBy("iter").pivot("k", ks).agg(F.first("p"))
