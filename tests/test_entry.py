"""The driver's contract: names, oracles and columns."""

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["modularity", "community_table", "sim_hpi", "coassoc", "provenance_join", "kruskal_h"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()]
    assert sorted(names) == sorted(got[0])
    key = lambda r: [(r[c] is None, str(r[c]) if not isinstance(r[c], float) else f"{r[c]:.6f}") for c in sorted(names)]
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
