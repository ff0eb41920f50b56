"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pyarrow as pa
from hubspark.llm import kernels, minhash

DOCS = "doc_id long, text string, lang string, band long, rep long, id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, need=85):
    sets, parent = [(i, shingles(t)) for i, t in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= need * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def edited(rnd, words, rate):
    return " ".join(f"{w}{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in words)


def made(rnd):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three four five six"), (7, "É a b c d e"), (8, "é a b c d e"), (9, "z" * 40_000)]
    for g, (size, rate) in enumerate([(40, 0.01), (60, 0.03), (30, 0.06), (5, 0.0)]):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        rows += [(100 + 1000 * g + rnd.randrange(10**9) * 0 + i, edited(rnd, base, rate)) for i in range(size)]
    rnd.shuffle(rows)
    return rows


def test_classes(spark, sf_dir):
    rows = made(random.Random(1))
    rows += [(10**6 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    got = [tuple(r) for r in minhash.near_duplicates(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert set(got) == want
    split = [tuple(r) for r in minhash.near_duplicates(table(spark, rows), block=7).collect()]
    assert set(split) == want
    assert any(n > 1 for n in (sum(c == k for _, _, c, _ in got) for k in {c for *_, c, _ in got}))


def test_odd_tables(spark):
    assert minhash.near_duplicates(table(spark, []).limit(0)).count() == 0
    text = " ".join(map(str, range(100)))
    rows = [(None, text), (4, text), (4, text), (4, "a b c d e f"), (2, "a b c d e f"), (9, text)]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [("2", 2, True), ("4", 2, False), ("4", 2, False), ("4", 2, False), ("9", 2, False), ("None", None, True)]
    left = sorted((str(r["doc_id"]), r["text"]) for r in minhash.one_of_each(table(spark, rows)).collect())
    assert left == [("2", "a b c d e f"), ("None", text)]


def test_kernels():
    texts = ["", None, "a", "  a  b ", "b\x0ba", "ab", "a" * 9000, "é\x1cx y", " "]
    for limit in (1, 5, 1 << 20):
        seen = []
        for a, b, data, bounds in kernels.slices(pa.array(texts), limit):
            start, end, first = kernels.word_bounds(data, bounds)
            h = kernels.word_hashes(data, start, end)
            for i in range(b - a):
                seen.append([(data[s:e].tobytes(), int(x)) for s, e, x in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], h[first[i] : first[i + 1]], strict=True)])
        assert [[w for w, _ in t] for t in seen] == [(t or "").encode().split() for t in texts]
        by = {}
        for t in seen:
            for w, x in t:
                assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)
    sliced = pa.array(["xx", *texts, "yy"]).slice(1, len(texts))
    assert sum(b - a for a, b, *_ in kernels.slices(sliced)) == len(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    values = np.concatenate((x[:900], x[100:]))
    sig = minhash.signature(kernels.mix(values), np.array([0, 900, 1800]), 300)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.06
