"""Held-out accuracy and odd inputs of the two classifiers."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hubspark.llm import quality_clf, toxicity

ODD = [None, "", " \n", "x", "w" * 30_000, "1d1ot " * 5000, "é" * 9, "%&$ $$$ ... ---", "a b c d e f g"]


def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").selectExpr("*", "1 as label", "2 as score", "3 as held_out")
    return docs, spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality", "toxic", "'x' as text")


@pytest.mark.parametrize(("score", "label", "folds", "fold", "at"), [(quality_clf.score_quality, "quality", 5, 0, 0.3), (toxicity.score_toxicity, "toxic", 3, 1, 0.7)])
def test_held_out(spark, score, label, folds, fold, at):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    odd = spark.createDataFrame([(10**6 + i, t, None, None, 1, 2, 3) for i, t in enumerate(ODD)] + [(None, "abc", None, None, 1, 2, 3)], docs.schema)
    rows = score(docs.union(odd).union(docs.limit(3)), labels).collect()
    assert len(rows) == docs.count() + len(ODD) + 4
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= at)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in out) >= 0.95 * len(out)


@pytest.mark.parametrize("score", [quality_clf.score_quality, toxicity.score_toxicity])
def test_no_labels(spark, sf_dir, score):
    docs, labels = tables(spark, sf_dir)
    assert {r["score"] for r in score(docs, labels.limit(0)).where("score <> 0.5").collect()} == set()
    assert score(docs.limit(0), labels).count() == 0


WORDS = ["idiot", "moron", "stupid", "worthless", "loser", "pathetic"]


def model():
    rnd = random.Random(0)
    parts = ["th", "he", "in", "er", "an", "ou", "ed", "tion", "st", "wh", "ble", "a", "re"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    texts, label = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(WORDS))
        texts.append(" ".join(w))
        label.append(int(i % 5 == 0))
    return toxicity.train(pa.array(texts), np.array(label)), word


def test_disguises_are_restored():
    m, word = model()
    for plain, said in [("idiot", "1d10t"), ("idiot", "i d i o t"), ("idiot", "IDIIIOT"), ("moron", "m.o.r.o.n"), ("stupid", "$tup1d"), ("worthless", "w0rthl3ss"), ("loser", "l-0-s-3-r"), ("pathetic", "p@th3t1c!!")]:
        said = said.lower().rstrip("!")
        assert toxicity.restore(said, m.chars) == plain
        clean = " ".join(word() for _ in range(40))
        score, n = toxicity.score_texts(pa.array([clean, f"{clean} {said.upper()} {said}, x"]), m)
        assert score[0] < 0.7 <= score[1]
        assert n[0] == 0 < n[1]


def test_viterbi_against_all_spellings():
    from itertools import product

    m, _ = model()
    for token in ("1d10t", "5t1p", "ha55", "too", "0x1"):
        runs = []
        for c in token:
            runs = [*runs[:-1], (c, runs[-1][1] + 1)] if runs and runs[-1][0] == c else [*runs, (c, 1)]
        options = []
        for c, n in runs:
            if c in toxicity.LEET:
                o = [(x * k, k * toxicity.SWAP + (k > 1) * toxicity.TWICE) for x in toxicity.LEET[c] for k in ({1} if n == 1 else {1, 2})] + [(c * min(n, 2), toxicity.ITSELF)]
            else:
                o = [(c, 0.0)] if n == 1 else [(c, toxicity.TWICE), (c * 2, 0.0 if n == 2 else toxicity.TWICE)]
            options.append(o)

        def value(parts):
            text, cost = "".join(t for t, _ in parts), sum(c for _, c in parts)
            padded = f"^^{text}$"
            return cost + sum(m.chars.logp(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))

        best = max(product(*options), key=value)
        assert toxicity.restore(token, m.chars) == "".join(t for t, _ in best)


def test_spelling_is_learned_from_all_documents(spark):
    """Words of documents without labels are spelled by their own trigrams, also with no labels at all."""
    texts = ["the plain words of a labelled text"] * 3 + ["qlzuvo qlzuvo brixqot", "brixqot", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        chars = toxicity.fit(docs, some).value.chars
        assert {"qlz", "zuv", "xqo", "pla"} <= set(chars.grams[2])
        assert chars.grams[2]["qlz"] == pytest.approx(2**0.5, abs=1e-3)
        assert toxicity.restore("q1zuv0", chars) == "qlzuvo"
        assert toxicity.restore("br1xq0t", chars) == "brixqot"


def test_neighbours_do_not_matter():
    m, word = model()
    rnd = random.Random(5)
    ends = ["!", "a", "1", "xx", "s.", "9", "$", " ", "", "st", "@"]
    starts = ["s.t.u.p.i.d", "1d1ot", "idiot", "xxx", "s t u p i d", "0", "", ".t.u", "b", "moron1"]
    texts = [f"{rnd.choice(starts)} {word()} {word()}{rnd.choice(ends)}" if rnd.random() < 0.8 else rnd.choice(starts + ends) for _ in range(600)]
    together = toxicity.score_texts(pa.array(texts), m)
    alone = [toxicity.score_texts(pa.array([t]), m) for t in texts]
    assert together[0].tolist() == [s[0] for s, _ in alone]
    assert together[1].tolist() == [t[0] for _, t in alone]
