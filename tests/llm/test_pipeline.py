"""The pipeline's stages on a small table, each against its own operator or a brute-force rule."""

import corpus_pipeline
import pytest
from test_minhash import shingles
from test_native import leaks


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_columns_and_sizes(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    sizes = [s.count() for s in stages]
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[4] == sizes[5]
    assert sizes[5] > 0.4 * sizes[0]
    assert stages[5].where("not round_trip").count() == 0


def test_one_of_each_class_stays(stages):
    before, after = ([(r["doc_id"], shingles(r["text"])) for r in s.collect()] for s in stages[2:4])
    kept = {d for d, _ in after}
    for a, (i, s) in enumerate(after):
        assert all(not (s and t) or 100 * len(s & t) < 80 * len(s | t) for _, t in after[:a]), i
    for i, s in before:
        if i not in kept:
            assert any(t and 100 * len(s & t) >= 80 * len(s | t) for j, t in before if j != i)


def test_leaks_go(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    clean = {i for (i, _), (*_, hit) in zip(rows, leaks([t for _, t in rows], items), strict=True) if not hit}
    assert {r["doc_id"] for r in stages[4].collect()} == clean


def test_run(spark, sf_dir, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["doc_id"] for r in stages[5].collect())
