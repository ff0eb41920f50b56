"""Further registered queries: centralities, tests, simulations, designs, joins of results, searches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import centrality, consensus, diffusion, frames, graph, metrics, quality, stats, windows
from ..operators.graph import Graph
from ..sources import bundles, graphs
from . import inputs, search
from .inputs import brands, nodes, parts, pool, read
from .queries import _CO, ORACLE_SQL, QUERIES, _lead, _peel, _pk, _trace, query, r9

__all__ = ["ORACLE_SQL", "QUERIES"]

COIN = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _eigen(steps: int) -> str:
    out = ", x0 AS (SELECT id, 1 / sqrt((SELECT n FROM n_all)) AS s FROM nodes)"
    for i in range(steps):
        out += f", y{i} AS MATERIALIZED (SELECT n.id, coalesce(sum(x.s), 0) AS s FROM nodes n LEFT JOIN adj a ON a.src = n.id LEFT JOIN x{i} x ON x.id = a.dst GROUP BY 1), x{i + 1} AS (SELECT id, s / (SELECT max(s) FROM y{i}) AS s FROM y{i})"
    return out + f" SELECT id, round(s / (SELECT sum(s) FROM x{steps}), 9) + 0.0 AS score FROM x{steps}"


@query(_eigen(6))
def eigen_k_steps(spark, sf):
    return r9(centrality.eigen_steps(parts(spark, sf), 6), "score")


def _pagerank(steps: int) -> str:
    out = ", p0 AS (SELECT id, degree, 1 / (SELECT n FROM n_all) AS s FROM strength)"
    for i in range(steps):
        out += f", p{i + 1} AS MATERIALIZED (SELECT t.id, t.degree, 0.15 / (SELECT n FROM n_all) + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(s), 0) FROM p{i} WHERE degree = 0) / (SELECT n FROM n_all)) AS s FROM strength t LEFT JOIN (SELECT a.src, sum(p.s / p.degree) AS g FROM adj a JOIN p{i} p ON p.id = a.dst GROUP BY 1) g ON g.src = t.id)"
    return out + f" SELECT id, round(s, 9) + 0.0 AS score FROM p{steps}"


@query(_pagerank(5))
def pagerank_k_steps(spark, sf):
    return r9(centrality.pagerank(parts(spark, sf), 0.85, 5), "score")


def _leaderrank(steps: int) -> str:
    """PageRank with a ground node -1 that is joined to all."""
    out = ", ga AS MATERIALIZED (SELECT src, dst FROM adj UNION ALL SELECT id, -1 FROM nodes UNION ALL SELECT -1, id FROM nodes), gd AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM ga GROUP BY 1), r0 AS (SELECT id, d, 1 / ((SELECT n FROM n_all) + 1) AS s FROM gd)"
    for i in range(steps):
        out += f", r{i + 1} AS MATERIALIZED (SELECT t.id, t.d, 0.15 / ((SELECT n FROM n_all) + 1) + 0.85 * g.g AS s FROM gd t JOIN (SELECT a.src, sum(r.s / r.d) AS g FROM ga a JOIN r{i} r ON r.id = a.dst GROUP BY 1) g ON g.src = t.id)"
    return out + f" SELECT id, round(s, 9) + 0.0 AS score FROM r{steps} WHERE id >= 0"


@query(_leaderrank(10))
def leaderrank(spark, sf):
    return r9(centrality.leaderrank(parts(spark, sf), steps=10), "score")


def _coreness(rounds: int) -> str:
    """Core numbers as the fixpoint of h-indices over neighbours, which starts at the degrees."""
    out = ", h0 AS MATERIALIZED (SELECT id, degree AS c FROM strength)"
    for i in range(rounds):
        out += f", h{i + 1} AS MATERIALIZED (SELECT n.id, coalesce(x.c, 0) AS c FROM nodes n LEFT JOIN (SELECT src, max(least(c, k)) AS c FROM (SELECT a.src, h.c, row_number() OVER (PARTITION BY a.src ORDER BY h.c DESC) AS k FROM adj a JOIN h{i} h ON h.id = a.dst) GROUP BY 1) x ON x.src = n.id)"
    return out + f" SELECT id, c::INT AS core FROM h{rounds}"


@query(_coreness(16))
def coreness(spark, sf):
    return centrality.coreness(parts(spark, sf)).withColumn("core", F.col("core").cast("int"))


_CENTRAL = 6


@query(_eigen(_CENTRAL).replace(f" SELECT id, round(s / (SELECT sum(s) FROM x{_CENTRAL}), 9) + 0.0 AS score FROM x{_CENTRAL}", f", sc AS (SELECT id, round(s / (SELECT sum(s) FROM x{_CENTRAL}), 12) AS score FROM x{_CENTRAL}) SELECT community, arg_max(id, (score, -id)) AS leader FROM m JOIN sc USING (id) GROUP BY 1"))
def derived_leaders(spark, sf):
    return quality.central_leaders(brands(spark, sf), centrality.eigen_steps(parts(spark, sf), _CENTRAL))


@query(""", co AS (SELECT e.src, e.dst, avg((x.community = y.community)::INT) AS co FROM edges e JOIN pool x ON x.id = e.src JOIN pool y ON y.id = e.dst AND y.iter = x.iter GROUP BY 1, 2),
conf AS (SELECT n.id, coalesce(avg(c.co), 0) AS confidence FROM nodes n LEFT JOIN (SELECT src AS id, co FROM co UNION ALL SELECT dst, co FROM co) c USING (id) GROUP BY 1),
other AS (SELECT community, max(id) AS leader FROM m GROUP BY 1), agree AS (SELECT count(*) AS n FROM leaders JOIN other USING (leader)), w(metric, value) AS (
SELECT 'q_consensus_weighted', 0.25 UNION ALL SELECT 'confidence_mean', (SELECT avg(confidence) FROM conf) UNION ALL SELECT 'confidence_min', (SELECT min(confidence) FROM conf)
UNION ALL SELECT 'leaders_agree_with_central', (SELECT n FROM agree) UNION ALL SELECT 'leaders_agree_frac', (SELECT n FROM agree) / (SELECT count(*) FROM leaders))
SELECT metric, round(value::DOUBLE, 9) + 0.0 AS value FROM w""")
def consensus_metrics(spark, sf):
    g, m, lead = _lead(spark, sf)
    other = m.groupBy("community").agg(F.max("id").alias("leader"))
    row = metrics.consensus_row(lead, other, consensus.confidence(g, consensus.coassociation(g, pool(spark, sf))), 0.25)
    return r9(metrics.tidy(row, "pool", "consensus").select("metric", "value"), "value")


@query(None)
def betweenness(spark, sf):
    return r9(centrality.betweenness(parts(spark, sf)), "score")


@query(None)
def closeness(spark, sf):
    return r9(centrality.closeness(parts(spark, sf)), "score")


@query(""", r(id, d) AS (SELECT id, 0 FROM (SELECT id FROM strength ORDER BY strength DESC, id LIMIT 1) UNION SELECT a.dst, r.d + 1 FROM r JOIN adj a ON a.src = r.id WHERE r.d < 3)
SELECT id, min(d)::INT AS distance FROM r GROUP BY 1""")
def hop_distances(spark, sf):
    g = parts(spark, sf)
    start = g.strength().orderBy(F.desc("strength"), "id").first()["id"]
    return centrality.hop_distances(g, start, 3)


# tests


def _sample(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("group"), F.col("p_size").cast("double").alias("value"))


def _two(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("y").alias("group"), F.round("p_retailprice", 0).alias("value"))


_KW = """s AS (SELECT p_partkey AS key, p_brand AS grp, p_size::DOUBLE AS value FROM part), r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM s),
g AS (SELECT grp, sum(rk) AS r, count(*) AS m FROM r GROUP BY 1), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM s GROUP BY value)), n AS (SELECT count(*)::DOUBLE AS n FROM s)
"""


@query("WITH " + _KW + "SELECT round((12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM g) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, (SELECT count(*) - 1 FROM g) AS df, n::BIGINT AS n FROM n, t", None)
def kruskal_h(spark, sf):
    return stats.kruskal(_sample(spark, sf)).withColumn("h", F.round("h", 6))


_TWO = "s AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'y' END AS grp, round(p_retailprice, 0) AS value FROM part)"


@query("WITH " + _TWO + f""", c AS (SELECT count(*) FILTER (grp = 'x') AS nx, count(*) FILTER (grp = 'y') AS ny, sum(value) AS s, avg(value) FILTER (grp = 'x') - avg(value) FILTER (grp = 'y') AS diff FROM s),
d AS (SELECT perm, value, row_number() OVER (PARTITION BY perm ORDER BY {COIN.format("'1|' || perm || '|' || key")}, key) AS rn_ FROM s, (SELECT unnest(range(1, 201)) AS perm)),
e AS (SELECT perm, sum(value) AS sx FROM d, c WHERE rn_ <= nx GROUP BY 1)
SELECT round(max(diff), 6) AS diff, round((count(*) FILTER (abs(sx / nx - (s - sx) / ny) >= abs(diff) - 1e-9) + 1) / 201, 9) AS p FROM e, c""", None)
def permutation_p(spark, sf):
    out = stats.permutation_test(_two(spark, sf), 200, 1)
    return out.select(F.round("diff", 6).alias("diff"), F.round("p", 9).alias("p"))


@query("SELECT i::INT AS i, round(least(1, 0.004 * i * 28)::DOUBLE, 9) AS p FROM (SELECT unnest(range(1, 29)) AS i)", None)
def bonferroni(spark, sf):
    p = spark.range(1, 29).select(F.col("id").cast("int").alias("i"), (F.lit(0.004) * F.col("id")).alias("p"))
    return p.select("i", F.round(stats.bonferroni("p", 28), 9).alias("p"))


_THREE = "s AS (SELECT (p_partkey % 3)::VARCHAR AS grp, p_retailprice + 40 * (p_partkey % 3 = 2)::INT AS value FROM part)"


def _three(spark, sf):
    third = F.col("p_partkey") % 3
    return read(spark, sf, "part").select(F.col("p_partkey").alias("key"), third.cast("string").alias("group"), (F.col("p_retailprice") + 40 * (third == 2).cast("int")).alias("value"))


@query("WITH " + _THREE + """, g AS (SELECT grp, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM s GROUP BY 1), t AS (SELECT sum(s * s / n) - sum(s) * sum(s) / sum(n) AS b, sum(q) - sum(s * s / n) AS w, count(*) - 1 AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM g)
SELECT round(b, 3) AS "between", round(w, 3) AS within, df1, df2, round((b / df1) / (w / df2), 6) AS f FROM t""", None)
def anova(spark, sf):
    return stats.anova(_three(spark, sf)).withColumns({"between": F.round("between", 3), "within": F.round("within", 3), "f": F.round("f", 6)})


@query(None)
def group_letters(spark, sf):
    """The rank test over three groups, then all pairs by permutation, as letters."""
    t = stats.kruskal_then_permute(_three(spark, sf), 199)
    return spark.createDataFrame([(g, x, round(t.p, 12)) for g, x in sorted(t.letters.items())], "group string, letter string, p double")


@query(None)
def effects(spark, sf):
    p = read(spark, sf, "part").select("p_size", (F.col("p_partkey") % 7).alias("rest"), "p_retailprice")
    return stats.effect_table(p, ["p_size", "rest"], "p_retailprice").withColumns({c: F.round(c, 6) for c in ("estimate", "se", "t")})


@query(None)
def response_surface(spark, sf):
    """Stationary point of a second-order surface over two factors of the parts."""
    p = read(spark, sf, "part").select((F.col("p_size") / 25 - 1).alias("a"), ((F.col("p_partkey") % 11) / 5 - 1).alias("b"), "p_retailprice")
    got = stats.stationary_point(p, ["a", "b"], "p_retailprice")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got["point"].items()], "factor string, at double")


@query("WITH " + _TWO + """, r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM s), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM s GROUP BY value)),
a AS (SELECT sum(rk) FILTER (grp = 'x') AS r, (count(*) FILTER (grp = 'x'))::DOUBLE AS nx, (count(*) FILTER (grp = 'y'))::DOUBLE AS ny FROM r), u AS (SELECT r - nx * (nx + 1) / 2 AS u, nx, ny, nx + ny AS n FROM a)
SELECT u, round((u - nx * ny / 2) / sqrt(nx * ny / 12 * (n + 1 - ties / (n * (n - 1)))), 9) AS z FROM u, t""", None)
def rank_sum(spark, sf):
    return r9(stats.rank_sum(_two(spark, sf)), "z")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT round(corr(a, b), 9) + 0.0 AS rho FROM r""", None)
def spearman(spark, sf):
    return r9(stats.spearman(read(spark, sf, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice"), "rho")


@query("SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept FROM part", None)
def ols_line(spark, sf):
    fit = stats.least_squares(read(spark, sf, "part"), ["p_size"], "p_retailprice")
    return spark.createDataFrame([(round(fit["p_size"]["estimate"], 6), round(fit["intercept"]["estimate"], 6))], "slope double, intercept double")


# simulations

_SEEDS = "(SELECT id FROM strength ORDER BY strength DESC, id LIMIT 5)"


def _seeds(g):
    return g.strength().orderBy(F.desc("strength"), "id").limit(5).select("id")


@query(f""", live AS (SELECT mc, src, dst FROM edges, (SELECT unnest(range(1, 6))::INT AS mc) WHERE {COIN.format("'3|' || mc || '|' || src || '|' || dst")} < {int(0.1 * 2**32)}),
both_ AS (SELECT mc, src, dst FROM live UNION ALL SELECT mc, dst, src FROM live),
r(mc, id) AS (SELECT mc, id FROM {_SEEDS}, (SELECT unnest(range(1, 6))::INT AS mc) UNION SELECT r.mc, b.dst FROM r JOIN both_ b ON b.mc = r.mc AND b.src = r.id)
SELECT mc, id FROM r""")
def ic_spread(spark, sf):
    g = parts(spark, sf)
    return diffusion.cascade(g, _seeds(g), 0.1, 5, 3)


def _lt(rounds: int) -> str:
    out = f", a0 AS (SELECT mc, id FROM {_SEEDS}, (SELECT unnest(range(1, 4))::INT AS mc))"
    for i in range(rounds):
        out += f""", a{i + 1} AS MATERIALIZED (SELECT mc, id FROM a{i} UNION SELECT k.mc, k.id FROM (SELECT a.mc, e.dst AS id, count(*) AS k FROM a{i} a JOIN adj e ON e.src = a.id GROUP BY 1, 2) k JOIN strength s USING (id)
 WHERE k.k / s.degree >= {COIN.format("'5|' || k.mc || '|' || k.id")} / 4294967296.0)"""
    return out + f" SELECT mc, id FROM a{rounds}"


@query(_lt(3))
def lt_spread(spark, sf):
    g = parts(spark, sf)
    return diffusion.threshold(g, _seeds(g), 3, 5, 3)


@query(f""", live AS (SELECT mc, src, dst FROM edges, (SELECT unnest(range(1, 9))::INT AS mc) WHERE {COIN.format("'4|' || mc || '|' || src || '|' || dst")} < {int(0.05 * 2**32)}),
both_ AS (SELECT mc, src, dst FROM live UNION ALL SELECT mc, dst, src FROM live),
r(mc, id) AS (SELECT mc, id FROM {_SEEDS}, (SELECT unnest(range(1, 9))::INT AS mc) UNION SELECT r.mc, b.dst FROM r JOIN both_ b ON b.mc = r.mc AND b.src = r.id),
sh AS (SELECT mc, count(*) / (SELECT n FROM n_all) AS share FROM r GROUP BY 1)
SELECT round(avg(share), 9) AS mean, round(stddev_samp(share), 9) AS sd, round(quantile_cont(share, 0.025), 9) AS lo, round(quantile_cont(share, 0.975), 9) AS hi FROM sh""")
def spread_summary(spark, sf):
    g = parts(spark, sf)
    return r9(diffusion.spread(diffusion.cascade(g, _seeds(g), 0.05, 8, 4), g.nodes.count()), "mean", "sd", "lo", "hi")


@query(None)
def greedy_im(spark, sf):
    g = parts(spark, sf)
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(diffusion.greedy_seeds(g, 3, g.nodes.select("id"), 0.1, 5, 3), 1)], "place int, id long")


@query(None)
def leader_influence(spark, sf):
    g, m, lead = _lead(spark, sf)
    return r9(diffusion.leader_influence(g, m, lead, 0.2, 5, 3), "within")


# generators and designs


@query(f"""WITH n AS (SELECT i AS id, CASE WHEN i > 60 THEN 2 ELSE 1 END AS b FROM (SELECT unnest(range(1, 121)) AS i))
SELECT x.id AS src, y.id AS dst, 1.0::DOUBLE AS w FROM n x JOIN n y ON x.id < y.id WHERE {COIN.format("'9|' || x.id || '|' || y.id")} < CASE WHEN x.b = y.b THEN {int(0.15 * 2**32)} ELSE {int(0.02 * 2**32)} END""", None)
def sbm_edges(spark, sf):
    return graphs.random_blocks(spark, [60, 60], 0.15, 0.02, 9).edges


@query(f"SELECT e.src, e.dst, round(CASE WHEN x.truth = y.truth THEN 1.5 + 2.5 * {COIN.format(chr(39) + '2|' + chr(39) + ' || e.src || ' + chr(39) + '|' + chr(39) + ' || e.dst')} / 4294967296.0 ELSE 0.1 + 0.9 * {COIN.format(chr(39) + '2|' + chr(39) + ' || e.src || ' + chr(39) + '|' + chr(39) + ' || e.dst')} / 4294967296.0 END, 9) AS w FROM edges e JOIN nodes x ON x.id = e.src JOIN nodes y ON y.id = e.dst")
def informative_weights(spark, sf):
    g = parts(spark, sf)
    return r9(graphs.informative_weights(g.edges, g.nodes, 2), "w")


@query("WITH d AS (SELECT a.a AS alpha_c, b.b AS alpha_s, r.r::INT AS rep FROM (SELECT unnest([0.1, 0.5, 0.9]) AS a) a, (SELECT unnest([0.1, 0.3]) AS b) b, (SELECT unnest(range(1, 4)) AS r) r) SELECT alpha_c::DOUBLE AS alpha_c, alpha_s::DOUBLE AS alpha_s, rep, row_number() OVER (ORDER BY alpha_c, alpha_s, rep)::INT AS row, (100 + row_number() OVER (ORDER BY alpha_c, alpha_s, rep))::INT AS seed FROM d", None)
def doe_grid(spark, sf):
    return stats.factorial(spark, {"alpha_c": [0.1, 0.5, 0.9], "alpha_s": [0.1, 0.3]}, 3, 100).select("alpha_c", "alpha_s", "rep", "row", "seed")


@query("""WITH c(kind, a, b) AS (VALUES ('corner', -1, -1), ('corner', 1, -1), ('corner', -1, 1), ('corner', 1, 1), ('axis', -sqrt(2), 0), ('axis', sqrt(2), 0), ('axis', 0, -sqrt(2)), ('axis', 0, sqrt(2)), ('centre', 0, 0))
SELECT kind, round(a::DOUBLE, 9) AS a, round(b::DOUBLE, 9) AS b, round(greatest(0.1, least(0.9, 0.5 + 0.4 * a))::DOUBLE, 9) AS a_actual FROM c""", None)
def ccd_design(spark, sf):
    d = stats.composite(spark, ["a", "b"])
    return r9(d.withColumn("a_actual", stats.actual(F.col("a"), 0.1, 0.9)), "a", "b", "a_actual")


# tables of results


@query("SELECT p_brand, p_size, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS ecdf, p_partkey FROM part", None)
def ecdf(spark, sf):
    return read(spark, sf, "part").select("p_brand", "p_size", F.round(windows.percentile_in("p_brand", "p_size"), 9).alias("ecdf"), "p_partkey")


@query("SELECT p_brand, min(p_size)::DOUBLE AS lo, quantile_cont(p_size, 0.25) AS q1, median(p_size)::DOUBLE AS mid, quantile_cont(p_size, 0.75) AS q3, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1", None)
def boxplot(spark, sf):
    p = F.percentile
    return read(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("lo"), p("p_size", 0.25).alias("q1"), p("p_size", 0.5).alias("mid"), p("p_size", 0.75).alias("q3"), F.max("p_size").cast("double").alias("hi"))


@query("SELECT k, round(avg(q), 9) AS mean, round(stddev_samp(q), 6) AS sd, min(q) AS lo, max(q) AS hi, count(*) AS n, round(stddev_samp(q) / sqrt(count(*)), 6) AS se FROM trace GROUP BY 1")
def group_summary(spark, sf):
    t = _trace(spark, sf).groupBy("k").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.count("*").alias("n"))
    t = t.withColumn("se", F.col("sd") / F.sqrt("n"))
    return r9(t, "mean").withColumns({c: F.round(c, 6) for c in ("sd", "se")})


@query("SELECT p_brand, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 10 AND p_size <= 30) AS middle, count(*) FILTER (p_size > 30) AS large FROM part GROUP BY 1", None)
def pivot_summary(spark, sf):
    kind = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large")
    return read(spark, sf, "part").withColumn("kind", kind).groupBy("p_brand").pivot("kind", ["small", "middle", "large"]).count().fillna(0)


@query("SELECT p_brand, 'lo' AS metric, min(p_size)::DOUBLE AS value FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'hi', max(p_size)::DOUBLE FROM part GROUP BY 1", None)
def unpivot_summary(spark, sf):
    t = read(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    return t.unpivot(["p_brand"], ["lo", "hi"], "metric", "value")


@query(f"SELECT t.iter, t.q, r.best, round(r.best - t.q, 9) + 0.0 AS gap FROM trace t LEFT JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) r(k, best) USING (k)")
def left_join_refs(spark, sf):
    refs = spark.createDataFrame([(0, 0.5), (1, 0.25)], "k int, best double")
    return r9(_trace(spark, sf).join(F.broadcast(refs), "k", "left").select("iter", "q", "best", (F.col("best") - F.col("q")).alias("gap")), "gap")


@query("""SELECT n_name AS dataset, 'run ' || n_regionkey AS generated_by, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN '2024-01-01' END, '2023-01-01') AS generated_on, CASE WHEN n_nationkey % 3 > 0 THEN '1.' || n_regionkey END AS first_release, CASE WHEN n_nationkey % 5 = 0 THEN sha256(n_name) END AS sha256 FROM nation""", None)
def provenance_join(spark, sf):
    n = read(spark, sf, "nation")
    name = F.col("n_name")
    meta = n.select(name.alias("dataset"), F.concat(F.lit("run "), "n_regionkey").alias("generated_by"), F.when(F.col("n_nationkey") % 2 == 0, "2024-01-01").otherwise("2023-01-01").alias("generated_on"))
    listed = n.where("n_nationkey % 3 > 0").select(name.alias("dataset"), F.lit("2020-01-01").alias("generated_on"), F.lit("-").alias("generated_by"), F.concat(F.lit("1."), "n_regionkey").alias("first_release"))
    sums = n.where("n_nationkey % 5 = 0").select(F.concat(name, F.lit(".parquet")).alias("file"), F.sha2(name, 256).alias("sha256"))
    return bundles.provenance(meta, listed, sums, ".parquet")


@query("SELECT n_name AS dataset, '2024-05-01' AS generated_on, 'run' AS generated_by, CASE WHEN n_nationkey % 2 = 0 THEN '1.0' ELSE '2.0' END AS first_release FROM nation", None)
def manifest_update(spark, sf):
    n = read(spark, sf, "nation")
    row = lambda df, release: df.select(F.col("n_name").alias("dataset"), F.lit("2024-05-01").alias("generated_on"), F.lit("run").alias("generated_by"), *([F.lit(release).alias("first_release")] if release else []))
    return bundles.updated_manifest(row(n.where("n_nationkey % 2 = 0"), "1.0"), row(n, None), "2.0")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 3 > 0", None)
def resume_cells(spark, sf):
    s, n = read(spark, sf, "supplier").select("s_suppkey"), read(spark, sf, "nation").select("n_nationkey")
    grid = s.crossJoin(F.broadcast(n))  # the grid of cells is the design itself
    return bundles.undone(grid, grid.where("(s_suppkey + n_nationkey) % 3 = 0"), ["s_suppkey", "n_nationkey"])


@query("SELECT p_brand AS method, count(*) AS n FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part) GROUP BY 1 UNION ALL SELECT min(p_brand), -1 FROM part", None)
def replace_method(spark, sf):
    t = read(spark, sf, "part").groupBy(F.col("p_brand").alias("method")).agg(F.count("*").alias("n"))
    first = t.agg(F.min("method").alias("m")).first()["m"]
    return bundles.replace_method(t, spark.createDataFrame([(first, -1)], "method string, n long"), first)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS work, l_suppkey AS name FROM lineitem), p AS (SELECT name, count(*) AS works FROM f GROUP BY 1 HAVING count(*) >= 5), i AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM p), k AS (SELECT work, id FROM f JOIN i USING (name))
SELECT a.id AS src, b.id AS dst, count(*)::DOUBLE AS w FROM k a JOIN k b ON a.work = b.work AND a.id < b.id GROUP BY 1, 2""", None)
def coauthor_edges(spark, sf):
    works = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.collect_list("l_suppkey").alias("authors"), F.count("*").alias("cited"))
    return graphs.coauthors(works, 5)[1]


@query("SELECT iter, q, max(q) OVER (ORDER BY iter) AS q_running_max FROM trace")
def grasp_trajectory(spark, sf):
    return frames.trajectory(_trace(spark, sf))


@query(None)
def plot_frames(spark, sf):
    g = graph.largest_component(parts(spark, sf))
    m = g.nodes.select("id").join(brands(spark, sf), "id")
    return frames.plot_frames(g, m, quality.top_degree_leaders(g, m))[0]


# searches


@query(None)
def result_metrics(spark, sf):
    """The overall table of an ensemble's result, without its running time."""
    r = search.ensemble(parts(spark, sf), b=4, seed=3, tau=0.7)
    return r9(r.metrics(), "value").where("metric <> 'elapsed_sec'")


@query(None)
def grasp_run(spark, sf):
    r = search.grasp(parts(spark, sf), b=4, seed=3)
    return r.membership.withColumn("q", F.lit(round(r.q, 9)))


@query(None)
def reactive_run(spark, sf):
    r = search.reactive(parts(spark, sf), b=16, m=4, y=8, seed=3)
    return r.membership.withColumn("q", F.lit(round(r.q, 9)))


@query(None)
def ensemble_run(spark, sf):
    r = search.ensemble(parts(spark, sf), b=8, seed=3, tau=0.7)
    return r.membership.join(r.extra["overlap"], "id")


@query(None)
def louvain(spark, sf):
    return search.louvain(parts(spark, sf))


@query(None)
def grasp_parts(spark, sf):
    """The batch search on the co-order graph: two starts."""
    r = search.grasp(parts(spark, sf), b=2, alpha_s=0.1, seed=3)
    return r.membership.withColumn("q", F.lit(round(r.q, 9)))


@query(None)
def pk_history(spark, sf):
    r = search.reactive(parts(spark, sf), b=8, m=4, y=4, seed=3)
    return frames.probabilities(spark.createDataFrame(r.history, "iter int, k int, p double"))
