"""The language model against plain counting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hubspark.llm import kernels, lm_score
from hubspark.llm.kernels import U

DOCS = "doc_id long, text string, key long, block long, bucket int, held_out int"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def reference(rows):
    """(scores by the definition, prob function, vocabulary, contexts) with dictionaries."""
    seqs = [tokens(t) for i, t in rows if not held(i)]
    counts = {n: Counter(tuple(s[k : k + n]) for s in seqs for k in range(len(s) - n + 1)) for n in (1, 2, 3)}
    total, kinds = sum(counts[1].values()), len(counts[1])

    def p(ctx, w):
        if not ctx:
            return (counts[1][(w,)] + 1) / (total + kinds + 1)
        k = lm_score.PRIOR[len(ctx) + 1]
        left = k / (counts[len(ctx)][ctx] + k)
        n = counts[len(ctx) + 1][(*ctx, w)]
        return left * p(ctx[1:], w) if not n else (n + k * p(ctx[1:], w)) / (counts[len(ctx)][ctx] + k)

    out = []
    for i, t in rows:
        s = tokens(t)
        score = sum(math.log10(p(tuple(s[max(0, k - 2) : k]), w)) for k, w in enumerate(s))
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + kinds + 1)) for w in s)
        out.append((i, held(i), len(s), sum(counts[1][(w,)] > 0 for w in s), total, base, score))
    return out, p, {w for (w,) in counts[1]}, [c for n in (1, 2) for c in counts[n] if None not in c]


def made():
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice((5, 30))]) for _ in range(rnd.randrange(40)))) for i in range(120)]
    return [*rows, (500, None), (501, ""), (502, "É w1  W1\x0bw2"), (503, "new words only"), (504, "z" * 9000), (None, "w1 w2"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (505, "w1 " * 3000)]


def same(got, want):
    order = lambda r: (str(r[0]), r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("block", "bucket"), [(1, 1), (300, 40), (8 << 20, 1 << 20)])
def test_scores(spark, block, bucket):
    rows = made()
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], DOCS)
    got = lm_score.score_texts(table, block=block, bucket_tokens=bucket).select(COLUMNS).collect()
    same(got, reference(rows)[0])


def test_states_sum_to_one():
    _, p, vocabulary, contexts = reference(made())
    for ctx in [*contexts[:20], *contexts[-20:]]:
        assert sum(p(ctx, w) for w in [*vocabulary, b"never seen"]) == pytest.approx(1)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(lm_score.score_texts(docs, block=1 << 16).select(COLUMNS).collect(), reference([(r["doc_id"], r["text"]) for r in docs.collect()])[0])


def test_nothing_to_learn(spark):
    held_out = next(i for i in range(100) if held(i))
    table = spark.createDataFrame([(held_out, "a b", 1, 2, 3, 4)], DOCS)
    (row,) = lm_score.score_texts(table).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0, 0)
    assert lm_score.score_texts(table.limit(0)).count() == 0


def test_better_than_its_base_on_held_out_texts(spark):
    rows = lm_score.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] >= r["base_score"] for r in rows) > 0.85 * len(rows)


def test_packed_keys():
    rng = np.random.default_rng(1)
    for keys in (np.unique(rng.integers(0, 2**64, 5000, dtype=U)), np.array([0, 2**64 - 1], dtype=U), np.zeros(0, dtype=U)):
        assert lm_score.unpack_sorted(lm_score.pack_sorted(keys)).tolist() == keys.tolist()


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=U))
    t = kernels.Table(keys)
    probe = np.concatenate((keys[::3], rng.integers(0, 2**64, 2000, dtype=U)))
    want = {k: i for i, k in enumerate(keys.tolist())}
    assert t.find(probe).tolist() == [want.get(k, -1) for k in probe.tolist()]
    assert kernels.Table(np.zeros(0, dtype=U)).find(probe).max() == -1
