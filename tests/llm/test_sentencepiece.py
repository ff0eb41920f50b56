"""Segmentation against a plain Viterbi search, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hubspark.llm import sentencepiece_scan as sp

DOCS = "doc_id long, text string, ids string, n long, row long, k int"
TEXTS = [None, "", " ", "a", "  a  b ", "日本語テキスト▁x\x00", "no_spaces_" * 300, "naïve café\n\n\tx", "the theory of everything " * 40, "x" * 1000, " " * 500, "é" * 700]


def small(seed):
    """A vocabulary over few letters in which most cuts matter."""
    rnd = random.Random(seed)
    pieces = [(bytes([b]), None) for b in range(256)]
    made = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(40)} | {" " + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 4))) for _ in range(15)} | {"  ", "   "}
    return sp.vocabulary(pieces + [(p.encode(), -rnd.randint(1, 5000)) for p in sorted(made)], list(range(256)))


def best(v, data, entry=0, size=None, leave=0):
    """Score of the best path from ``entry`` to ``size + leave`` with pieces that start before ``size``."""
    size = len(data) if size is None else size
    score = {p: s for p, s in zip(v.pieces, v.scores.tolist(), strict=True) if s != sp.BYTE_SCORE}
    out = {entry: 0}
    for t in range(entry + 1, size + leave + 1):
        for k in range(1, min(t - entry, v.reach) + 1):
            p = data[t - k : t]
            s = score.get(p, sp.BYTE_SCORE if k == 1 else None)
            if len(p) == k and s is not None and t - k in out and t - k < size:
                out[t] = max(out.get(t, sp.LOW), out[t - k] + s)
        if size < t < size + leave:
            continue
    return out.get(size + leave, sp.LOW)


def strings(rnd, n):
    return ["".join(rnd.choice(["a", "b", "c", "a", "b", "c", " ", "é"]) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["".join(rnd.choice("abc") for _ in range(900)), "abc" * 200 + " " + "cab" * 150]


@pytest.mark.parametrize("seed", range(4))
def test_best_score(seed, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 16)
    v = small(seed)
    texts = strings(random.Random(seed), 60)
    for a, _, ids, at, same in sp.encode_column(v, pa.array(texts)):
        assert same.all()
        for i in range(len(at) - 1):
            own = ids[at[i] : at[i + 1]]
            if texts[a + i]:
                assert v.scores[own].sum() == best(v, b" " + texts[a + i].encode())
            else:
                assert not len(own)


def test_matrices_compose():
    v = small(9)
    rnd = random.Random(1)
    for text in strings(rnd, 6)[-5:]:
        data = (" " + text + " abc").encode()
        w, n = v.reach, len(data)
        if n < 4 * w:
            continue
        buf = np.frombuffer(data, dtype=np.uint8)
        cut_at = rnd.randrange(w, n - w)
        left, right = sp.part_matrix(v, buf[: cut_at + w - 1], cut_at), sp.part_matrix(v, buf[cut_at:], n - cut_at)
        whole = sp.combine(left[None], right[None])[0]
        # a part's matrix leaves out what all its paths share
        for m, bytes_, size in ((whole, data, n), (left, data[: cut_at + w - 1], cut_at)):
            shared = best(v, bytes_, 0, size) - m[0, 0]
            for e in range(w):
                for o in range(w if m is left else 1):
                    want = best(v, bytes_, e, size, o)
                    assert m[e, o] + shared == want or max(m[e, o], want) < sp.LOW // 2
    m = np.random.default_rng(0).integers(-50, 0, (7, 4, 4))
    step = m[0]
    for x in m[1:]:
        step = sp.combine(step[None], x[None])[0]
    assert (sp.reduce_all(m) == step).all()


@pytest.mark.parametrize("part", [30, 64, 1 << 20])
def test_parts_of_giant_texts(spark, part):
    v = small(3)
    texts = [*strings(random.Random(4), 20), *TEXTS]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, 2, 3), (None, "abc" * 50, "x", 1, 2, 3)], DOCS)
    encoded = sp.encode(docs, v, part)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 2
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    for r in rows:
        text = "abc" * 50 if r["doc_id"] is None else texts[r["doc_id"]]
        if text:
            assert v.scores[r["ids"]].sum() == best(v, b" " + text.encode())
    back = {r["doc_id"]: r["text"] for r in sp.decode(encoded, v).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_public_vocabulary(spark, sf_dir):
    v = sp.load()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.union(odd).collect()}
    encoded = sp.encode(docs.union(odd), v, 2000)
    assert encoded.where("not round_trip").count() == 0
    assert {r["doc_id"]: r["text"] for r in sp.decode(encoded, v).collect()} == texts
    assert sp.encode(docs.limit(0), v).count() == 0
    with pytest.raises(ValueError, match="longest piece"):
        sp.encode(docs, v, 3)
