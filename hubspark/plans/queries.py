"""Registered queries of the graph engine, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import graph, metrics, quality, recovery, similarity, windows
from . import inputs
from .inputs import brands, nodes, parts, pool, prelude, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, least: int | None = 2):
    """Registers a function under its name; ``sql`` follows the prelude of the graph with edges of at least ``least``."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (prelude(least) if least else "") + sql
        return f

    return put


def r9(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded as the oracle rounds; adding 0 turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in cols})


# graphs


@query("SELECT src, dst, w FROM edges", 1)
def canonical_edges(spark, sf):
    return parts(spark, sf, 1).edges


@query("SELECT src, dst, w FROM adj")
def adjacency_sym(spark, sf):
    return parts(spark, sf).adj


@query("SELECT id, degree, strength FROM strength", 1)
def degree_strength(spark, sf):
    return parts(spark, sf, 1).strength()


@query("SELECT i AS id, count(e.w) AS degree FROM (SELECT unnest(range(1, (SELECT max(greatest(src, dst)) FROM edges) + 4)) AS i) LEFT JOIN adj e ON e.src = i GROUP BY 1")
def pad_isolates(spark, sf):
    e = parts(spark, sf).edges
    top = e.select(F.max(F.greatest("src", "dst")).alias("n")).first()["n"]
    return graph.from_edge_list(e, top + 3).strength().select("id", "degree")


@query("SELECT s.s_suppkey AS src, t.s_suppkey AS dst, 1.0::DOUBLE AS w FROM supplier s, supplier t WHERE s.s_suppkey < t.s_suppkey AND (s.s_suppkey + t.s_suppkey) % 3 = 0", None)
def adjacency_matrix(spark, sf):
    ids = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    n = ids.agg(F.max("id").alias("n")).first()["n"]
    rows = ids.withColumn("values", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.when((F.col("id") + j) % 3 == 0, 2.0).otherwise(0.0)))
    return graph.from_adjacency(rows).edges


@query(""", reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT a.dst, r.c FROM reach r JOIN adj a ON a.src = r.id AND a.dst > r.c),
lab AS (SELECT id, min(c) AS c FROM reach GROUP BY 1), top AS (SELECT c FROM lab GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)
SELECT id, c AS component FROM lab WHERE c = (SELECT c FROM top)""", 3)  # fmt: skip
def largest_component(spark, sf):
    g = parts(spark, sf, 3)
    comps = graph.components(g)
    return graph.largest_component(g).nodes.select("id").join(comps, "id").select("id", "component")


@query("SELECT a.cs AS community, count(*)::BIGINT AS n_edges, sum(a.w) AS weight FROM ends a WHERE a.cs = a.cd AND a.src < a.dst GROUP BY 1")
def induced_subgraphs(spark, sf):
    e = quality.ends(parts(spark, sf), brands(spark, sf)).where("cs = cd and src < dst")
    return e.groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"))


# scores of a partition


@query("SELECT round(sum(intra) / max(two_w) - sum(vol * vol) / (max(two_w) * max(two_w)), 9) + 0.0 AS q FROM sums", 1)
def modularity(spark, sf):
    return r9(quality.modularity(parts(spark, sf, 1), brands(spark, sf)), "q")


@query("SELECT iter, q FROM pool_q")
def modularity_pool(spark, sf):
    return r9(quality.modularity(parts(spark, sf), pool(spark, sf), ("iter",)), "q")


_AFF = """, vols AS (SELECT community, vol FROM sums), aff AS MATERIALIZED (SELECT s.id, v.community, coalesce(e.e, 0) - s.strength * v.vol / t.two_w AS s, s.strength, t.two_w
 FROM strength s CROSS JOIN vols v CROSS JOIN (SELECT sum(strength) AS two_w FROM strength) t
 LEFT JOIN (SELECT src, cd, sum(w) AS e FROM ends GROUP BY 1, 2) e ON e.src = s.id AND e.cd = v.community)
"""


@query(_AFF + "SELECT id, community, round(s, 9) + 0.0 AS s FROM aff")
def affinity_matrix(spark, sf):
    return r9(quality.affinity(parts(spark, sf), brands(spark, sf)), "s").select("id", "community", "s")


_GAIN = """, own AS MATERIALIZED (SELECT id, community AS current, s AS s_own FROM aff JOIN m USING (id, community)), gain AS (
 SELECT a.id, o.current, a.community AS target, CASE WHEN a.community = o.current THEN 0 ELSE (a.s - o.s_own - a.strength * a.strength / a.two_w) / (a.two_w / 2) END AS gain FROM aff a JOIN own o USING (id))
"""


@query(_AFF + _GAIN + "SELECT id, current, target, round(gain, 9) + 0.0 AS gain FROM gain")
def delta_modularity(spark, sf):
    return r9(quality.gains(parts(spark, sf), brands(spark, sf)), "gain")


def _lead(spark, sf):
    g, m = parts(spark, sf), brands(spark, sf)
    return g, m, quality.top_degree_leaders(g, m)


@query("SELECT round(avg(h), 9) + 0.0 AS h FROM leaders JOIN node_h ON id = leader")
def nce_global(spark, sf):
    g, _, lead = _lead(spark, sf)
    return r9(quality.entropy_global(g, lead), "h")


@query("""SELECT round(avg(CASE WHEN size > 1 AND inner_ > 0 AND inner_ < size - 1 THEN -(inner_ / (size - 1) * log2(inner_ / (size - 1)) + (1 - inner_ / (size - 1)) * log2(1 - inner_ / (size - 1))) ELSE 0 END), 9) + 0.0 AS h FROM links""")
def nce_local(spark, sf):
    g, m, lead = _lead(spark, sf)
    return r9(quality.entropy_local(g, m, lead), "h")


@query(""", il AS (SELECT m.community, m.id, z.size, coalesce(i.k, 0) AS k FROM m JOIN sizes z USING (community) LEFT JOIN (SELECT src, count(*) AS k FROM ends WHERE cs = cd GROUP BY 1) i ON i.src = m.id),
sc AS (SELECT il.community, il.id, round(0.5 * (CASE WHEN size > 1 AND k > 0 AND k < size - 1 THEN -(k / (size - 1) * log2(k / (size - 1)) + (1 - k / (size - 1)) * log2(1 - k / (size - 1))) ELSE 0 END) + 0.5 * h0, 9) AS score FROM il JOIN node_h USING (id))
SELECT community, arg_max(id, (score, -id)) AS leader, max(score) + 0.0 AS score FROM sc GROUP BY 1""")
def nce_mix_leader(spark, sf):
    return quality.mixed_leaders(parts(spark, sf), brands(spark, sf)).withColumn("score", F.col("score") + 0.0)


@query("SELECT id, round(participation, 9) + 0.0 AS participation FROM part_")
def participation(spark, sf):
    return r9(quality.participation(parts(spark, sf), brands(spark, sf)), "participation")


@query("SELECT round(count(*) / (SELECT n FROM n_all), 9) AS coverage FROM (SELECT leader AS id FROM leaders UNION SELECT dst FROM adj JOIN leaders ON src = leader)")
def leader_coverage(spark, sf):
    g, _, lead = _lead(spark, sf)
    return r9(quality.coverage(g, lead), "coverage")


@query(""", r AS (SELECT leader, leader AS id FROM leaders UNION SELECT leader, dst FROM leaders JOIN adj ON src = leader UNION SELECT l.leader, b.dst FROM leaders l JOIN adj a ON a.src = l.leader JOIN adj b ON b.src = a.dst)
SELECT x.community, r.leader, round(count(*) / max(z.size), 9) AS coverage FROM r JOIN m x ON x.id = r.leader JOIN m y ON y.id = r.id AND y.community = x.community JOIN sizes z ON z.community = x.community GROUP BY 1, 2""")
def two_hop_coverage(spark, sf):
    g, m, lead = _lead(spark, sf)
    return r9(quality.two_hop_coverage(g, m, lead), "coverage")


@query("SELECT iter, count(*) AS n_communities, min(size) AS size_min, round(median(size), 9) AS size_median, round(avg(size), 9) AS size_mean, max(size) AS size_max, round(coalesce(stddev_samp(size), 0), 9) AS size_sd, count(*) FILTER (size = 1) AS singleton_communities FROM (SELECT iter, community, count(*) AS size FROM pool GROUP BY 1, 2) GROUP BY 1")
def size_stats(spark, sf):
    return r9(quality.size_stats(pool(spark, sf), ("iter",)), "size_median", "size_mean", "size_sd")


# similarity and candidate lists

_START = "(SELECT id AS start FROM strength ORDER BY strength DESC, id LIMIT 3)"
_SIM = f""", st AS (SELECT start FROM {_START}), cn AS (SELECT st.start, b.dst AS id, count(*) AS common FROM st JOIN adj a ON a.src = st.start JOIN adj b ON b.src = a.dst GROUP BY 1, 2),
sr AS (SELECT st.start, n.id, coalesce(c.common, 0) AS c, d.degree AS kid, e.degree AS kst FROM st CROSS JOIN nodes n LEFT JOIN cn c ON c.start = st.start AND c.id = n.id JOIN strength d ON d.id = n.id JOIN strength e ON e.id = st.start)
"""


def _starts(g):
    return g.strength().orderBy(F.desc("strength"), "id").limit(3).select(F.col("id").alias("start"))


@query(_SIM + "SELECT start, id, common FROM cn")
def common_neighbours(spark, sf):
    g = parts(spark, sf)
    return similarity.common_neighbours(g, _starts(g))


def _sim(kind, divisor, times=""):
    @query(_SIM + f"SELECT start, id, CASE WHEN start = id THEN 1 WHEN {divisor} > 0 THEN round({times}c / ({divisor}), 9) ELSE 0 END::DOUBLE AS sim FROM sr")
    def f(spark, sf):
        g = parts(spark, sf)
        return r9(similarity.similarity(g, _starts(g), g.nodes, kind), "sim")

    name = f"sim_{kind}"
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_sim("hpi", "least(kid, kst)")
_sim("dice", "kid + kst", "2 * ")
_sim("jaccard", "kid + kst - c")


def _scores(spark, sf):
    return parts(spark, sf).strength().join(brands(spark, sf), "id").select("community", "id", F.col("strength").alias("score"))


_SC = ", sc AS (SELECT community, id, strength AS score, min(strength) OVER (PARTITION BY community) AS lo, max(strength) OVER (PARTITION BY community) AS hi FROM strength JOIN m USING (id)) "


@query(_SC + "SELECT community, id, score FROM sc WHERE score >= hi - 0.25 * (hi - lo)")
def rcl_max(spark, sf):
    return similarity.candidates_max(_scores(spark, sf), 0.25, ("community",))


@query(_SC + "SELECT community, id, score FROM sc WHERE score >= lo + 0.25 * (hi - lo)")
def rcl_min(spark, sf):
    return similarity.candidates_floor(_scores(spark, sf), 0.25, ("community",))


@query(", sc AS (SELECT community, id, CASE WHEN id % 7 = 0 THEN NULL ELSE strength END AS score FROM strength JOIN m USING (id)) SELECT community, id, coalesce(score, min(score) OVER (PARTITION BY community), 0) AS score FROM sc")
def nonfinite_fill(spark, sf):
    odd = F.when(F.col("id") % 21 == 0, F.lit(float("nan"))).when(F.col("id") % 14 == 0, F.lit(float("-inf"))).when(F.col("id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("score"))
    return similarity.fill_non_finite(_scores(spark, sf).withColumn("score", odd), ("community",))


# recovery


def _cells(spark, sf):
    return recovery.contingency(nodes(spark, sf).select("id", F.col("truth").alias("x")), brands(spark, sf).select("id", F.col("community").alias("y")))


@query("SELECT x, y, n FROM cells")
def contingency(spark, sf):
    return _cells(spark, sf)


_AGREE = """, t AS (SELECT sum(n)::BIGINT AS n, sum(n * ln(n)) AS l, sum(n * (n - 1) / 2) AS p FROM cells), fx AS (SELECT x, sum(n) AS n FROM cells GROUP BY 1), fy AS (SELECT y, sum(n) AS n FROM cells GROUP BY 1),
a AS (SELECT t.*, (SELECT sum(n * ln(n)) FROM fx) AS lx, (SELECT sum(n * ln(n)) FROM fy) AS ly, (SELECT sum(n * (n - 1) / 2) FROM fx) AS px, (SELECT sum(n * (n - 1) / 2) FROM fy) AS py,
 (SELECT sum(b)::BIGINT FROM (SELECT max(n) AS b FROM cells GROUP BY x)) AS mx, (SELECT sum(b)::BIGINT FROM (SELECT max(n) AS b FROM cells GROUP BY y)) AS my FROM t),
h AS (SELECT *, n * (n - 1) / 2 AS pairs, ln(n) - lx / n AS hx, ln(n) - ly / n AS hy, ln(n) - l / n AS hxy FROM a)
"""


def _agree(name, sql):
    @query(_AGREE + f"SELECT {sql} AS {name} FROM h")
    def f(spark, sf):
        out = recovery.agreement(_cells(spark, sf)).select(name)
        return out if name == "split_join" else r9(out, name)

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_agree("nmi", "round(2 * (hx + hy - hxy) / (hx + hy), 9) + 0.0")
_agree("ari", "round((p - px * py / pairs) / ((px + py) / 2 - px * py / pairs), 9) + 0.0")
_agree("rand", "round((pairs + 2 * p - px - py) / pairs, 9) + 0.0")
_agree("vi", "round(2 * hxy - hx - hy, 9) + 0.0")
_agree("split_join", "2 * n - mx - my")


@query("SELECT y, size, x AS dominant, round(n / size, 9) AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY y)::BIGINT AS size, row_number() OVER (PARTITION BY y ORDER BY n DESC, x) AS rn_ FROM cells) WHERE rn_ = 1")
def purity(spark, sf):
    return r9(recovery.purity(_cells(spark, sf)), "purity")


@query(""", pc AS (SELECT a.iter AS i, b.iter AS j, a.community AS x, b.community AS y, count(*) AS n FROM pool a JOIN pool b ON a.id = b.id AND a.iter < b.iter GROUP BY ALL),
ht AS (SELECT i, j, sum(n) AS n, sum(n * ln(n)) AS l FROM pc GROUP BY ALL), hx AS (SELECT i, j, sum(n * ln(n)) AS l FROM (SELECT i, j, x, sum(n) AS n FROM pc GROUP BY ALL) GROUP BY ALL), hy AS (SELECT i, j, sum(n * ln(n)) AS l FROM (SELECT i, j, y, sum(n) AS n FROM pc GROUP BY ALL) GROUP BY ALL)
SELECT i, j, round(2 * ((ln(n) - hx.l / n) + (ln(n) - hy.l / n) - (ln(n) - ht.l / n)) / ((ln(n) - hx.l / n) + (ln(n) - hy.l / n)), 9) + 0.0 AS nmi FROM ht JOIN hx USING (i, j) JOIN hy USING (i, j)""")
def pairwise_nmi(spark, sf):
    return r9(recovery.pairwise_nmi(pool(spark, sf)), "nmi")


# metric tables


@query("""SELECT s.community, s.size, l.leader, n.name AS leader_name, d.strength AS leader_degree, coalesce(e.i, 0) AS internal_edges, coalesce(e.b, 0) AS boundary_edges,
 CASE WHEN s.size > 1 THEN round(coalesce(e.i, 0) / (s.size * (s.size - 1) / 2), 9) END AS internal_density,
 CASE WHEN least(s.vol, s.two_w - s.vol) > 0 THEN round((s.vol - s.intra) / least(s.vol, s.two_w - s.vol), 9) END AS conductance,
 round(s.intra / s.two_w - (s.vol / s.two_w) * (s.vol / s.two_w), 9) + 0.0 AS q_contribution, p.x AS truth_dominant, round(p.n / p.size, 9) AS purity
FROM sums s LEFT JOIN (SELECT cs, (count(*) FILTER (cs = cd) / 2)::BIGINT AS i, count(*) FILTER (cs <> cd) AS b FROM ends GROUP BY 1) e ON e.cs = s.community
JOIN leaders l USING (community) JOIN nodes n ON n.id = l.leader JOIN strength d ON d.id = l.leader
JOIN (SELECT *, sum(n) OVER (PARTITION BY y)::BIGINT AS size, row_number() OVER (PARTITION BY y ORDER BY n DESC, x) AS rn_ FROM cells) p ON p.y = s.community AND p.rn_ = 1""")
def community_table(spark, sf):
    g, m, lead = _lead(spark, sf)
    return r9(metrics.community_table(g, m, lead, g.nodes.select("id", "truth")), "internal_density", "conductance", "q_contribution", "purity")


_RANKED = """, ranked AS (SELECT m.id, m.community, s.degree, s.strength, rank() OVER (PARTITION BY community ORDER BY strength DESC) AS rk, cume_dist() OVER (PARTITION BY community ORDER BY strength) AS pc, count(*) OVER (PARTITION BY community) AS size,
 n.score, n.name, rank() OVER (PARTITION BY community ORDER BY n.score DESC) AS srk, cume_dist() OVER (PARTITION BY community ORDER BY n.score) AS spc FROM m JOIN strength s USING (id) JOIN nodes n USING (id))
"""


@query(_RANKED + """SELECT r.community, l.leader, r.name, r.size AS community_size, r.strength AS degree, coalesce(i.w, 0) AS degree_within, r.strength - coalesce(i.w, 0) AS degree_between, round(h.h, 9) AS nce_node, round(p.participation, 9) + 0.0 AS participation,
 r.rk::INT AS degree_rank_in_community, round(r.pc, 9) AS degree_pctile_in_community, r.score, r.srk::INT AS score_rank, round(r.spc, 9) AS score_pctile
FROM leaders l JOIN ranked r ON r.id = l.leader LEFT JOIN (SELECT src, sum(w) AS w FROM ends WHERE cs = cd GROUP BY 1) i ON i.src = l.leader JOIN node_h h ON h.id = l.leader JOIN part_ p ON p.id = l.leader""")
def leader_table(spark, sf):
    g, m, lead = _lead(spark, sf)
    return r9(metrics.leader_table(g, m, lead, g.nodes.select("id", "score")), "nce_node", "participation", "degree_pctile_in_community", "score_pctile")


@query(_AGREE + _RANKED + """, w(metric, scope, value) AS (
SELECT 'n_nodes', 'partition', (SELECT n FROM n_all) UNION ALL SELECT 'n_edges', 'partition', (SELECT count(*) FROM edges) UNION ALL SELECT 'total_edge_weight', 'partition', (SELECT sum(w) FROM edges)
UNION ALL SELECT 'q', 'partition', (SELECT sum(intra) / max(two_w) - sum(vol * vol) / (max(two_w) * max(two_w)) FROM sums)
UNION ALL SELECT 'n_communities', 'partition', (SELECT count(*) FROM sizes) UNION ALL SELECT 'size_min', 'partition', (SELECT min(size) FROM sizes) UNION ALL SELECT 'size_median', 'partition', (SELECT median(size) FROM sizes)
UNION ALL SELECT 'size_mean', 'partition', (SELECT avg(size) FROM sizes) UNION ALL SELECT 'size_max', 'partition', (SELECT max(size) FROM sizes) UNION ALL SELECT 'size_sd', 'partition', (SELECT stddev_samp(size) FROM sizes) UNION ALL SELECT 'singleton_communities', 'partition', (SELECT count(*) FROM sizes WHERE size = 1)
UNION ALL SELECT 'n_leaders', 'leaders', (SELECT count(*) FROM leaders) UNION ALL SELECT 'leader_degree_mean', 'leaders', (SELECT avg(strength) FROM leaders JOIN strength ON id = leader) UNION ALL SELECT 'leader_degree_max', 'leaders', (SELECT max(strength) FROM leaders JOIN strength ON id = leader)
UNION ALL SELECT 'leader_participation_mean', 'leaders', (SELECT avg(participation) FROM leaders JOIN part_ ON id = leader) UNION ALL SELECT 'h_global', 'leaders', (SELECT avg(h) FROM leaders JOIN node_h ON id = leader)
UNION ALL SELECT 'h_local', 'leaders', (SELECT avg(CASE WHEN size > 1 AND inner_ > 0 AND inner_ < size - 1 THEN -(inner_ / (size - 1) * log2(inner_ / (size - 1)) + (1 - inner_ / (size - 1)) * log2(1 - inner_ / (size - 1))) ELSE 0 END) FROM links)
UNION ALL SELECT 'leaders_derived', 'leaders', 0 UNION ALL SELECT 'leader_coverage', 'leaders', (SELECT count(*) / (SELECT n FROM n_all) FROM (SELECT leader AS id FROM leaders UNION SELECT dst FROM adj JOIN leaders ON src = leader))
UNION ALL SELECT 'score_pctile_mean', 'leader_score', (SELECT avg(spc) FROM ranked JOIN leaders ON id = leader) UNION ALL SELECT 'score_top1_rate', 'leader_score', (SELECT avg((srk <= 1)::INT) FROM ranked JOIN leaders ON id = leader) UNION ALL SELECT 'score_top3_rate', 'leader_score', (SELECT avg((srk <= 3)::INT) FROM ranked JOIN leaders ON id = leader)
UNION ALL SELECT 'nmi', 'recovery', (SELECT 2 * (hx + hy - hxy) / (hx + hy) FROM h) UNION ALL SELECT 'ari', 'recovery', (SELECT (p - px * py / pairs) / ((px + py) / 2 - px * py / pairs) FROM h) UNION ALL SELECT 'rand', 'recovery', (SELECT (pairs + 2 * p - px - py) / pairs FROM h)
UNION ALL SELECT 'vi', 'recovery', (SELECT 2 * hxy - hx - hy FROM h) UNION ALL SELECT 'split_join', 'recovery', (SELECT 2 * n - mx - my FROM h) UNION ALL SELECT 'n_communities_truth', 'recovery', (SELECT count(DISTINCT truth) FROM nodes)
UNION ALL SELECT 'b', 'search', (SELECT count(*) FROM trace) UNION ALL SELECT 'trace_q_mean', 'search', (SELECT avg(q) FROM trace) UNION ALL SELECT 'trace_q_sd', 'search', (SELECT stddev_samp(q) FROM trace) UNION ALL SELECT 'trace_q_min', 'search', (SELECT min(q) FROM trace) UNION ALL SELECT 'trace_q_max', 'search', (SELECT max(q) FROM trace) UNION ALL SELECT 'trace_h_mean', 'search', (SELECT avg(h) FROM trace))
SELECT 'brand' AS algorithm, scope, metric, round(value::DOUBLE, 9) + 0.0 AS value FROM w""")
def overall_metrics(spark, sf):
    g, m, lead = _lead(spark, sf)
    t = inputs.trace(g, pool(spark, sf))
    return r9(metrics.overall_table(g, m, lead, "brand", g.nodes.select("id", "truth"), g.nodes.select("id", "score"), t), "value")


# windows, order, sets


@query(_RANKED + "SELECT id, community, rk::INT AS degree_rank FROM ranked")
def rank_in_community(spark, sf):
    return brands(spark, sf).join(parts(spark, sf).strength(), "id").select("id", "community", windows.rank_in("community", "strength").alias("degree_rank"))


@query(_RANKED + "SELECT id, community, round(pc, 9) AS pctile FROM ranked")
def pctile_in_community(spark, sf):
    return r9(brands(spark, sf).join(parts(spark, sf).strength(), "id").select("id", "community", windows.percentile_in("community", "strength").alias("pctile")), "pctile")


def _trace(spark, sf):
    return inputs.trace(parts(spark, sf), pool(spark, sf))


@query("SELECT iter, q, max(q) OVER (ORDER BY iter) AS q_running_max FROM trace")
def running_max_q(spark, sf):
    return _trace(spark, sf).select("iter", "q", windows.running_max("q", "iter").alias("q_running_max"))


@query(""", o AS (SELECT *, row_number() OVER (ORDER BY iter) AS rn_ FROM trace), f AS (SELECT rn_, iter AS best_iter, q, h, 0 AS decisive FROM o WHERE rn_ = 1 UNION ALL
SELECT o.rn_, CASE WHEN o.q > f.q + 1e-12 OR (abs(o.q - f.q) <= 1e-12 AND o.h > f.h + 1e-12) THEN o.iter ELSE f.best_iter END, CASE WHEN o.q > f.q + 1e-12 OR (abs(o.q - f.q) <= 1e-12 AND o.h > f.h + 1e-12) THEN o.q ELSE f.q END,
 CASE WHEN o.q > f.q + 1e-12 OR (abs(o.q - f.q) <= 1e-12 AND o.h > f.h + 1e-12) THEN o.h ELSE f.h END, f.decisive + CASE WHEN abs(o.q - f.q) < 1e-12 AND abs(o.h - f.h) > 1e-12 THEN 1 ELSE 0 END FROM f JOIN o ON o.rn_ = f.rn_ + 1)
SELECT best_iter, q, h, decisive FROM f ORDER BY rn_ DESC LIMIT 1""")
def lex_fold(spark, sf):
    return windows.incumbent(_trace(spark, sf))


@query("SELECT iter, id, dense_rank() OVER (PARTITION BY iter ORDER BY community * community)::INT AS community FROM pool")
def renumber(spark, sf):
    return windows.renumber(pool(spark, sf).withColumn("community", F.col("community") * F.col("community")), ("iter",))


@query(_RANKED + "SELECT community, id, strength, row_number() OVER (PARTITION BY community ORDER BY strength DESC, id)::INT AS place FROM ranked QUALIFY place <= 3")
def topk_per_group(spark, sf):
    rows = brands(spark, sf).join(parts(spark, sf).strength(), "id").select("community", "id", "strength")
    return windows.top_k(rows, "community", "strength", "id", 3)


@query(_RANKED + "SELECT community, id, strength, rk::INT AS place FROM ranked WHERE rk <= 3")
def topk_with_ties(spark, sf):
    rows = brands(spark, sf).join(parts(spark, sf).strength(), "id").select("community", "id", "strength")
    return windows.top_k(rows, "community", "strength", "id", 3, ties=True)


@query("SELECT iter, k, round(CASE WHEN max(q) OVER w > min(q) OVER w THEN (q - min(q) OVER w) / (max(q) OVER w - min(q) OVER w) ELSE 0 END, 6) AS q01 FROM trace WINDOW w AS (PARTITION BY k)")
def minmax_norm(spark, sf):
    return _trace(spark, sf).select("iter", "k", F.round(windows.min_max("q", "k"), 6).alias("q01"))


@query("SELECT id, strength, row_number() OVER (ORDER BY strength DESC, id)::INT AS place FROM strength ORDER BY strength DESC, id LIMIT 10")
def top_seeds(spark, sf):
    top = parts(spark, sf).strength().orderBy(F.desc("strength"), "id").limit(10)
    return top.select("id", "strength", F.row_number().over(W.orderBy(F.desc("strength"), "id")).alias("place"))  # 10 rows


@query("SELECT leader AS id FROM leaders UNION SELECT id FROM (SELECT id FROM strength ORDER BY strength DESC, id LIMIT 20)")
def set_union(spark, sf):
    g, _, lead = _lead(spark, sf)
    return lead.select(F.col("leader").alias("id")).union(g.strength().orderBy(F.desc("strength"), "id").limit(20).select("id")).distinct()


@query("SELECT leader AS id FROM leaders INTERSECT SELECT id FROM (SELECT id FROM strength ORDER BY strength DESC, id LIMIT 20)")
def set_intersect(spark, sf):
    g, _, lead = _lead(spark, sf)
    return lead.select(F.col("leader").alias("id")).intersect(g.strength().orderBy(F.desc("strength"), "id").limit(20).select("id"))


@query("SELECT id FROM nodes EXCEPT SELECT src FROM adj")
def set_except(spark, sf):
    g = parts(spark, sf)
    return g.nodes.select("id").join(g.adj.select(F.col("src").alias("id")), "id", "left_anti").distinct()


# pools


@query("SELECT e.src, e.dst, round(avg((x.community = y.community)::INT), 9) AS co, e.w FROM edges e JOIN pool x ON x.id = e.src JOIN pool y ON y.id = e.dst AND y.iter = x.iter GROUP BY e.src, e.dst, e.w")
def coassoc(spark, sf):
    from ..operators import consensus

    return r9(consensus.coassociation(parts(spark, sf), pool(spark, sf)), "co")


@query(f"SELECT leader AS id, count(*) AS n, round(count(*) / {inputs.POOL}, 9) AS freq FROM pool_leaders GROUP BY 1")
def lead_count(spark, sf):
    from ..operators import consensus

    g = parts(spark, sf)
    return r9(consensus.lead_counts(inputs.pool_leaders(g, pool(spark, sf)), inputs.POOL), "freq")


_CO = """, co AS (SELECT e.src, e.dst, avg((x.community = y.community)::INT) AS co FROM edges e JOIN pool x ON x.id = e.src JOIN pool y ON y.id = e.dst AND y.iter = x.iter GROUP BY 1, 2),
co2 AS (SELECT src, dst, co FROM co UNION ALL SELECT dst, src, co FROM co)
"""


@query(_CO + "SELECT n.id, round(coalesce(avg(co.co), 0), 9) AS confidence FROM nodes n LEFT JOIN co2 co ON co.src = n.id GROUP BY 1")
def confidence(spark, sf):
    from ..operators import consensus

    g = parts(spark, sf)
    return r9(consensus.confidence(g, consensus.coassociation(g, pool(spark, sf))), "confidence")


@query(_CO + """, aff AS (SELECT c.src AS id, m.community, round(avg(c.co), 9) AS a FROM co2 c JOIN m ON m.id = c.dst GROUP BY 1, 2), keep AS (SELECT id, community FROM (SELECT *, max(a) OVER (PARTITION BY id) AS top FROM aff) WHERE a >= 0.7 * top UNION SELECT id, community FROM m)
SELECT id, list_sort(list(DISTINCT community)) AS communities, count(DISTINCT community) > 1 AS is_overlap FROM keep GROUP BY 1""")
def overlap_sets(spark, sf):
    from ..operators import consensus

    g = parts(spark, sf)
    return consensus.overlap(g, brands(spark, sf), consensus.coassociation(g, pool(spark, sf)), 0.7)


@query(", pairs AS (SELECT k, 0.1 + 0.2 * k AS alpha FROM (SELECT unnest(range(0, 5))::INT AS k)) SELECT p.k, p.alpha, round(coalesce(avg(t.q), 0), 9) + 0.0 AS mu, count(t.q) AS n FROM pairs p LEFT JOIN trace t USING (k) GROUP BY 1, 2")
def reactive_mu(spark, sf):
    from ..operators import consensus

    ks = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.lit(0.1) + F.lit(0.2) * F.col("id")).alias("alpha"))
    return r9(consensus.running_means(ks, _trace(spark, sf)), "mu")


_P = """, mu AS (SELECT k, greatest(coalesce(avg(t.q), 0) + 0.001, 0) AS mu FROM (SELECT unnest(range(0, 5))::INT AS k) LEFT JOIN trace t USING (k) GROUP BY 1), best AS (SELECT max(q) + 0.001 AS q FROM trace),
pk AS (SELECT k, CASE WHEN s > 0 THEN 0.95 * (mu / s) ELSE 0.95 / 5 END + 0.05 / 5 AS p FROM (SELECT k, mu / best.q AS mu, sum(mu / best.q) OVER () AS s FROM mu, best))
"""


def _pk(spark, sf):
    from ..operators import consensus

    ks = spark.range(5).select(F.col("id").cast("int").alias("k"))
    t = _trace(spark, sf)
    mu = consensus.running_means(ks, t).select("k", (F.col("mu") + 0.001).alias("mu"))
    return consensus.refresh(mu, t.agg((F.max("q") + 0.001).alias("best")), 0.05)


@query(_P + "SELECT k, round(p, 9) AS p FROM pk")
def reactive_p_refresh(spark, sf):
    return r9(_pk(spark, sf), "p")


@query(_P + "SELECT round(-sum(p * ln(p)), 9) AS entropy FROM pk WHERE p > 0")
def pk_entropy(spark, sf):
    return r9(_pk(spark, sf).where("p > 0").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy")), "entropy")


@query(", s AS (SELECT q.iter, string_agg(community, ',' ORDER BY id) AS s FROM pool JOIN pool_q q USING (iter) WHERE q.q >= (SELECT max(q) FROM pool_q) - 0.01 GROUP BY 1) SELECT count(DISTINCT s) AS n_distinct, count(*) AS n FROM s")
def distinct_partitions(spark, sf):
    from ..operators import consensus

    g, p = parts(spark, sf), pool(spark, sf)
    return consensus.distinct_partitions(p, r9(quality.modularity(g, p, ("iter",)), "q"), 0.01)


@query(""", b AS (SELECT unnest([2, 4, 8]) AS b), c AS (SELECT b.b, e.src, e.dst, avg((x.community = y.community)::INT) AS co FROM b JOIN pool x ON x.iter <= b.b JOIN edges e ON e.src = x.id JOIN pool y ON y.id = e.dst AND y.iter = x.iter GROUP BY 1, 2, 3)
SELECT b::INT AS b, round(avg(abs(co - prev)), 9) AS drift FROM (SELECT *, lag(co) OVER (PARTITION BY src, dst ORDER BY b) AS prev FROM c) GROUP BY 1""")
def coassoc_drift(spark, sf):
    from ..operators import consensus

    return r9(consensus.drift(parts(spark, sf), pool(spark, sf), [2, 4, 8]), "drift")


@query(""", vp AS (SELECT id FROM nodes ORDER BY ('0x' || substr(md5('7|' || id), 1, 8))::BIGINT, id LIMIT 300)""" + _AFF + _GAIN + """, best AS (SELECT id, arg_max(target, (round(gain, 9), -target)) AS target, max(round(gain, 9)) AS gain FROM gain JOIN vp USING (id) GROUP BY 1)
SELECT id, target AS community, gain FROM best WHERE gain > 1e-4""")
def vnmi_one_pass(spark, sf):
    from . import search

    g = parts(spark, sf)
    sample = search.sample_nodes(g, 7, 300)
    return search.proposals(g, brands(spark, sf), sample, 1e-4)


def _peel(rounds: int) -> str:
    """Rounds of peeling, unrolled; the data settle long before the last."""
    out = ", k0 AS (SELECT id FROM strength WHERE degree >= 2)"
    for i in range(rounds):
        out += f", k{i + 1} AS (SELECT a.src AS id FROM adj a JOIN k{i} x ON x.id = a.src JOIN k{i} y ON y.id = a.dst GROUP BY 1 HAVING count(*) >= 2)"
    return out.replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + f" SELECT e.src, e.dst FROM edges e JOIN k{rounds} x ON x.id = e.src JOIN k{rounds} y ON y.id = e.dst"


@query(_peel(25))
def two_core(spark, sf):
    from ..operators import centrality

    return centrality.two_core_edges(parts(spark, sf)).select("src", "dst")
