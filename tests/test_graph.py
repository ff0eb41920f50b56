"""Invariants of scores, searches and statistics on small graphs."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hubspark.functions import kernels, rng
from hubspark.operators import centrality, consensus, graph, metrics, quality, recovery, similarity, stats, windows
from hubspark.plans import search
from hubspark.sources import bundles, graphs
from pyspark.sql import functions as F

BEST = [{1, 2, 3, 4, 8, 12, 13, 14, 18, 20, 22}, {5, 6, 7, 11, 17}, {9, 10, 15, 16, 19, 21, 23, 27, 30, 31, 33, 34}, {24, 25, 26, 28, 29, 32}]


@pytest.fixture(scope="module")
def karate(spark):
    return graphs.karate(spark)


def table(spark, groups):
    return spark.createDataFrame([(i, c) for c, g in enumerate(groups, 1) for i in sorted(g)], "id long, community int")


def gnp(n, p, seed, weighted=False):
    r = random.Random(seed)
    pairs = [(i, j) for i, j in combinations(range(1, n + 1), 2) if r.random() < p]
    return kernels.csr_of(range(1, n + 1), *(np.array(x) for x in zip(*pairs, strict=True)), np.array([r.uniform(0.3, 4) if weighted else 1.0 for _ in pairs]))


def frame(spark, g):
    keep = g.src < g.dst
    return graph.Graph(spark.createDataFrame([(int(i),) for i in g.ids], "id long"), spark.createDataFrame(pd.DataFrame({"src": g.ids[g.src[keep]], "dst": g.ids[g.dst[keep]], "w": g.w[keep]})))


def test_karate_scores(spark, karate):
    assert karate.edges.count() == 78
    assert quality.modularity(karate, table(spark, BEST)).first()["q"] == pytest.approx(0.4197896, abs=1e-7)
    moved = [BEST[0] | {10}, BEST[1], BEST[2] - {10}, BEST[3]]
    assert quality.modularity(karate, table(spark, moved)).first()["q"] == pytest.approx(0.4188034, abs=1e-7)
    gain = quality.gains(karate, table(spark, BEST)).where("id = 10 and target = 1").first()["gain"]
    assert gain == pytest.approx(0.4188034 - 0.4197896, abs=1e-6)


@pytest.mark.parametrize("weighted", [False, True])
def test_gains_and_updates(weighted):
    g = gnp(40, 0.15, 1, weighted)
    com = np.array([random.Random(i).randrange(4) for i in range(g.n)])
    s = kernels.affinities(g, com, 4)
    gain = kernels.gains(g, s, com)
    for v in range(0, g.n, 3):
        for t in range(4):
            after = com.copy()
            after[v] = t
            assert gain[v, t] == pytest.approx(kernels.modularity(g, after) - kernels.modularity(g, com), abs=1e-10)
    kernels.move(g, s, com, 5, (com[5] + 1) % 4)
    assert np.allclose(s, kernels.affinities(g, com, 4))


def test_tables_agree_with_arrays(spark):
    g = gnp(40, 0.12, 2, True)
    f = frame(spark, g)
    com = np.arange(g.n) % 3
    m = spark.createDataFrame([(int(i), int(c) + 1) for i, c in zip(g.ids, com, strict=True)], "id long, community int")
    assert quality.modularity(f, m).first()["q"] == pytest.approx(kernels.modularity(g, com))
    assert quality.contributions(f, m).agg(F.sum("q_contribution")).first()[0] == pytest.approx(kernels.modularity(g, com))
    want = kernels.gains(g, kernels.affinities(g, com, 3), com)
    for r in quality.gains(f, m).collect():
        assert r["gain"] == pytest.approx(want[r["id"] - 1, r["target"] - 1], abs=1e-9)
    start = spark.createDataFrame([(7,)], "start long")
    for kind in ("hpi", "dice", "jaccard"):
        sims = kernels.similarities(g, 6, np.arange(g.n), kind)
        assert {r["id"]: round(r["sim"], 9) for r in similarity.similarity(f, start, f.nodes, kind).collect()} == {int(i): round(float(s), 9) for i, s in zip(g.ids, sims, strict=True)}
    sample = search.sample_nodes(f, 3, 15)
    places = np.sort(g.places(np.array([r["id"] for r in sample.collect()])))
    batch = kernels.batch_search(g, com, places, 1e-4, 3)
    assert {r["id"]: r["community"] - 1 for r in search.batch_search(f, m, 3, 15, 1e-4, 3).collect()} == dict(zip(g.ids.tolist(), batch.tolist(), strict=True))
    t = metrics.community_table(f, m, quality.top_degree_leaders(f, m)).toPandas()
    assert t["size"].sum() == g.n
    assert t["internal_edges"].sum() + t["boundary_edges"].sum() / 2 == len(g.src) / 2


def test_local_search_never_loses():
    for seed in range(3):
        g = gnp(60, 0.1, seed)
        com = np.array([random.Random(seed * 100 + i).randrange(5) for i in range(g.n)])
        after = kernels.first_improvement(g, com)
        assert kernels.modularity(g, after) >= kernels.modularity(g, com)
        guarded = kernels.batch_search(g, com, np.arange(g.n), guard=True, max_passes=20)
        assert kernels.modularity(g, guarded) >= kernels.modularity(g, com)


def test_candidate_lists(spark):
    scores = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id long, score double")
    sizes = [similarity.candidates_max(scores, a).count() for a in (0, 0.2, 0.5, 1)]
    assert sizes == sorted(sizes)
    assert (sizes[0], sizes[-1]) == (7, 50)
    equal = scores.withColumn("score", F.lit(0.0))
    assert similarity.candidates_floor(equal, 0.9).count() == 50


def test_repair_is_the_best_of_each_subgraph():
    g = gnp(80, 0.06, 4)
    com = kernels.dense(np.array([random.Random(i).randrange(6) for i in range(g.n)]))
    for c, leader in enumerate(kernels.repair(g, com)):
        inside = com == c
        scores = kernels.central(g, "eigen", inside)
        assert inside[leader]
        assert leader == np.flatnonzero(inside)[np.argmax(scores[inside])]


def test_star_has_an_odd_centrality():
    src = np.array([0, 1, 2, 3, 3, 3])
    dst = np.array([3, 3, 3, 0, 1, 2])
    x = kernels.power_iteration(src, dst, 4)
    assert x[0] == pytest.approx(x[1])  # unshifted steps do not settle on a bipartite graph
    assert kernels.power_iteration(np.array([], int), np.array([], int), 4)[0] == 0.5


def test_path_centralities(spark, karate):
    line = graph.from_edge_list(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long"))
    assert {r["id"]: r["score"] for r in centrality.betweenness(line).collect()} == {1: 0, 2: 2, 3: 2, 4: 0}
    assert {r["id"]: r["score"] for r in centrality.closeness(line).collect()} == pytest.approx({1: 0.5, 2: 0.75, 3: 0.75, 4: 0.5})
    core = {r["id"]: r["core"] for r in centrality.coreness(karate).collect()}
    assert (core[1], core[12], core[10]) == (4, 1, 2)
    ev = kernels.central(kernels.collect(karate), "eigen")
    assert ev[33] == pytest.approx(0.075003, abs=1e-5)
    steps = {r["id"]: r["score"] for r in centrality.eigen_steps(karate, 4).collect()}
    x = np.ones(34)
    g = kernels.collect(karate)
    for _ in range(4):
        x = np.bincount(g.src, weights=x[g.dst])
        x /= x.max()
    assert steps == pytest.approx(dict(zip(range(1, 35), (x / x.sum()).tolist(), strict=True)))


def test_searches(spark, karate):
    for r in (search.grasp(karate, b=6, seed=2), search.reactive(karate, b=12, m=4, y=6, seed=2), search.ensemble(karate, b=8, seed=2, tau=0.7)):
        rows = r.membership.toPandas()
        assert sorted(rows["id"]) == list(range(1, 35))
        assert sorted(set(rows["community"])) == list(range(1, rows["community"].max() + 1))
        assert r.leaders.count() == rows["community"].nunique()
        assert r.q <= 0.41979
        assert r.q == pytest.approx(quality.modularity(karate, r.membership).first()["q"])
    assert r.extra["overlap"].count() == 34
    again = search.grasp(karate, b=6, seed=2)
    assert again.trace["q"].tolist() == search.grasp(karate, b=6, seed=2).trace["q"].tolist()
    p = search.reactive(karate, b=8, m=4, y=4, seed=2).history.groupby("iter")["p"]
    assert np.allclose(p.sum(), 1)
    assert (p.min() >= 0.05 / 4 - 1e-12).all()
    assert search.louvain(karate).count() == 34
    for bad in (lambda: search.grasp(karate, b=0), lambda: search.grasp(karate, alpha_c=2.0), lambda: search.grasp(karate, centrality="x"), lambda: search.detect(karate, "x")):
        with pytest.raises(ValueError):
            bad()


def test_incumbent_order(spark):
    rows = [(1, 0.4, 2.0), (2, 0.4, 3.0), (3, 0.39, 9.0), (4, 0.4, 1.0)]
    best = windows.incumbent(spark.createDataFrame(rows, "iter int, q double, h double")).first()
    assert (best["best_iter"], best["decisive"]) == (2, 2)
    assert search.fold(pd.DataFrame(rows, columns=["iter", "q", "h"])) == (2, [2, 4])


def test_agreement_ends(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, x int")
    same = recovery.agreement(recovery.contingency(a, a.withColumnRenamed("x", "y"))).first()
    assert (same["nmi"], same["ari"], same["rand"], same["split_join"]) == pytest.approx((1, 1, 1, 0))
    one = a.select("id", F.lit(1).alias("y"))
    assert recovery.agreement(recovery.contingency(a, one)).first()["nmi"] == pytest.approx(0)
    flat = recovery.agreement(recovery.contingency(a.select("id", F.lit(1).alias("x")), one)).first()
    assert (flat["nmi"], flat["ari"]) == (1, None)


def test_participation_ends(spark, karate):
    alone = karate.nodes.select("id", F.col("id").cast("int").alias("community"))
    deg = {r["id"]: r["degree"] for r in karate.strength().collect()}
    for r in quality.participation(karate, alone).collect():
        assert r["participation"] == pytest.approx(1 - 1 / deg[r["id"]])
    whole = karate.nodes.select("id", F.lit(1).alias("community"))
    assert quality.participation(karate, whole).agg(F.max(F.abs("participation"))).first()[0] == pytest.approx(0)


def test_statistics(spark):
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(40.0, 10) == pytest.approx(1.694e-5, rel=1e-3)
    p = {("1", "2"): 1.0, ("2", "3"): 1.0, ("1", "3"): 0.0}
    assert stats.letters(["1", "2", "3"], p) == {"1": "a", "2": "a", "3": "a"}
    assert stats.letters(["1", "2", "3"], p, strict=True) == {"1": "a", "2": "a", "3": "b"}
    same = spark.createDataFrame([(i, "ab"[i % 2], 1.0) for i in range(10)], "key long, group string, value double")
    assert stats.kruskal_then_permute(same, 50).rejected is False
    apart = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2) * 5 + i / 100) for i in range(40)], "key long, group string, value double")
    found = stats.kruskal_then_permute(apart, 200)
    assert found.rejected
    assert found.letters == {"a": "b", "b": "a"}
    fit = stats.least_squares(spark.createDataFrame([(float(x), 2.0 + 3 * x) for x in range(9)], "x double, y double"), ["x"], "y")
    assert fit["x"]["estimate"] == pytest.approx(3)
    bowl = spark.createDataFrame([(float(x), float(y), (x - 1.0) ** 2 + 2 * (y + 2.0) ** 2) for x in range(-3, 4) for y in range(-3, 4)], "x double, y double, z double")
    assert stats.stationary_point(bowl, ["x", "y"], "z")["point"] == pytest.approx({"x": 1, "y": -2})


def test_coin(spark):
    row = spark.createDataFrame([(5,)], "id long").select(rng.coin(3, "id").alias("c")).first()
    assert row["c"] == rng.coin_of(3, 5)


def test_readers(spark, tmp_path):
    (tmp_path / "a.gml").write_text('graph [\n directed 1\n node [ id 0 label "x y" value 3 ]\n node [ id 7 label "z" ]\n node [ id 9 ]\n edge [ source 0 target 7 ]\n edge [ source 7 target 0 ]\n edge [ source 9 target 9 ]\n]')
    g = graphs.read_gml(spark, str(tmp_path / "a.gml"))
    assert [tuple(r) for r in g.nodes.orderBy("id").collect()] == [(1, "x y", "3"), (2, "z", None), (3, None, None)]
    assert [tuple(r) for r in g.edges.collect()] == [(1, 2, 1.0)]
    (tmp_path / "e.txt").write_text("1 2\n2 1\n3 3\n")
    (tmp_path / "t.txt").write_text("a\nb\na\nb\n")
    h = graphs.read_edge_list(spark, str(tmp_path / "e.txt"), str(tmp_path / "t.txt"))
    assert (h.nodes.count(), h.edges.count()) == (4, 1)
    np.savez(tmp_path / "g.npz", adj_data=np.array([1.0, 2.0]), adj_indices=np.array([1, 0]), adj_indptr=np.array([0, 1, 2]), labels=np.array([5, 6]))
    z = graphs.read_npz(spark, str(tmp_path / "g.npz"))
    assert [tuple(r) for r in z.edges.collect()] == [(1, 2, 2.0)]
    meta = bundles.make_meta("d", "test", "made up")
    bundles.save(spark.range(3), str(tmp_path), meta)
    rows, back = bundles.load(spark, str(tmp_path), "d")
    assert (rows.count(), back) == (3, meta)
    assert [r["dataset"] for r in bundles.datasets(spark, str(tmp_path)).collect()] == ["d"]
    with pytest.warns(UserWarning, match="no dataset"):
        assert bundles.load(spark, str(tmp_path), "none") is None
    with pytest.raises(ValueError, match="network_source"):
        bundles.make_meta("d", "test", " ")


def test_overlap_bridge(spark):
    e = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 7), (7, 4)]
    g = graph.from_edge_list(spark.createDataFrame(e, "src long, dst long"))
    m = table(spark, [{1, 2, 3, 7}, {4, 5, 6}])
    co = g.edges.select("src", "dst", F.lit(0.5).alias("co"), "w")
    sets = {r["id"]: r["communities"] for r in consensus.overlap(g, m, co, 0.7).collect()}
    assert sets[7] == [1, 2]
    assert sets[1] == [1]
    assert not math.isnan(consensus.confidence(g, co).agg(F.avg("confidence")).first()[0])


def test_greedy_seeds_come_from_all_nodes(spark, sf_dir, monkeypatch):
    from hubspark.plans import queries_more

    pools = []
    monkeypatch.setattr(queries_more.diffusion, "greedy_seeds", lambda g, k, candidates, *rest: pools.append((candidates, g)) or [1])
    queries_more.QUERIES["greedy_im"](spark, sf_dir)
    ((candidates, g),) = pools
    assert {r["id"] for r in candidates.collect()} == {r["id"] for r in g.nodes.select("id").collect()}


def test_metrics_of_results(spark, karate):
    tables = {}
    for method, how in (("grasp", {"b": 3}), ("reactive", {"b": 6, "m": 3, "y": 3}), ("ensemble", {"b": 6, "tau": 0.7})):
        r = search.detect(karate, method, seed=2, **how)
        tables[method] = {(x["scope"], x["metric"]): x["value"] for x in r.metrics().collect()}
        lead = r.metrics("leader").collect()
        assert all(0 < x["eigen_centrality"] <= 1 for x in lead)
        assert len(lead) == tables[method]["leaders", "n_leaders"]
        assert abs(sum(x["q_contribution"] for x in r.metrics("community").collect()) - r.q) < 1e-9
    assert "lex_decisive_n" in {m for _, m in tables["reactive"]}
    assert not {m for _, m in tables["grasp"]} & {"lex_decisive_n", "confidence_mean"}
    pool = {m: v for (s, m), v in tables["ensemble"].items() if s == "consensus"}
    assert set(pool) == {"q_consensus_weighted", "confidence_mean", "confidence_min", "leaders_agree_with_central", "leaders_agree_frac", "overlap_nodes", "overlap_frac"}
    assert 0 <= pool["leaders_agree_frac"] <= 1
    with pytest.raises(ValueError, match="level"):
        r.metrics("nodes")


def test_seeds(spark, karate):
    a = search.grasp(karate, b=2, seed=None)
    b = search.grasp(karate, b=2, seed=a.params["seed"])
    assert a.q == b.q
    assert {tuple(r) for r in a.membership.collect()} == {tuple(r) for r in b.membership.collect()}
    for bad in ("1", 1.5, True):
        with pytest.raises(ValueError, match="single integer"):
            search.grasp(karate, b=2, seed=bad)


def test_variance_tables(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i % 3 * 2 + i % 2)) for i in range(30)], "key long, group string, value double")
    row = stats.anova(df).first()
    assert (row["df1"], row["df2"]) == (2, 27)
    assert row["between"] == pytest.approx(80)
    assert row["within"] == pytest.approx(7.5)
    assert stats.anova(df.withColumn("value", stats.F.lit(1.0))).first()["f"] is None
    terms = [r["term"] for r in stats.effect_table(df.withColumn("x", df.key % 3), ["x"], "value").collect()]
    assert terms == ["x", "intercept"]
    with pytest.raises(ValueError, match="52"):
        stats.kruskal_then_permute(spark.range(60).selectExpr("id as key", "cast(id as string) as group", "1.0D as value"))
