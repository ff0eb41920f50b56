"""Quality classifier by supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, a document is their
mean, and a softmax layer gives the class (Joulin et al. 2017). Trained by
stochastic gradient descent in numpy on a bounded labelled sample. For scoring
the layer is folded into the vectors: the logit of a mean of vectors is the
mean of their logits, so a feature costs one lookup in a table of floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, _byte_table, constants, slices, word_bounds, word_hashes
from .samples import labelled_texts, remainder

BUCKETS = 1 << 17
#: Labelled rows used for training: the documented bound.
MAX_TRAIN = 3000
GRAMS = (3, 4)
#: Two buckets of their own: a word equal to the one before it, and one that differs.
SAME, OTHER = BUCKETS, BUCKETS + 1


def feature_slices(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, [(buckets, bounds per text)]): words, word repetitions and character n-grams of whole texts."""
    mask = U(BUCKETS - 1)
    for a, b, data, bounds in slices(column):
        start, end, first = word_bounds(data, bounds)
        h = word_hashes(data, start, end)
        same = np.full(len(h), OTHER, dtype=np.int64)
        same[1:][h[1:] == h[:-1]] = SAME
        heads = first[:-1][np.diff(first) > 0]
        same[heads] = OTHER
        groups = [((h & mask).astype(np.int64), first), (same, first)]
        codes = _byte_table()[data]
        for n in GRAMS:
            counts = np.maximum(np.diff(bounds) - (n - 1), 0)
            acc = np.zeros(max(0, len(data) - n + 1), dtype=U)
            for c, j in zip(constants(20 + n, n), range(n), strict=True):
                acc += codes[j : len(data) - n + 1 + j] * c
            acc ^= acc >> U(32)
            keep = np.zeros(len(acc) + 1, dtype=np.int64)
            lengths = np.diff(bounds)
            some = lengths >= n
            np.add.at(keep, bounds[:-1][some], 1)
            np.add.at(keep, bounds[1:][some] - (n - 1), -1)
            inside = np.cumsum(keep[:-1]) > 0
            groups.append(((acc[inside] & mask).astype(np.int64), np.concatenate(([0], np.cumsum(counts)))))
        yield a, b, groups


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for a, b, groups in feature_slices(texts):
        for i in range(b - a):
            ids, counts = np.unique(np.concatenate([f[g[i] : g[i + 1]] for f, g in groups]), return_counts=True)
            out.append((ids, counts / max(1, counts.sum())))
    return out


def train(texts: pa.Array, label: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """(logit per bucket, bias) of class 1 against class 0. One class only, or no rows: its smoothed log odds as bias."""
    ones = int((label == 1).sum())
    zeros = len(label) - ones
    if not ones or not zeros:
        return np.zeros(BUCKETS + 2, dtype=np.float32), float(np.log((ones + 1) / (zeros + 1)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim))
    layer, bias = np.zeros((2, dim)), np.zeros(2)
    bags = _bags(texts)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(dim)
            z = layer @ mean + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[1 if label[i] == 1 else 0] -= 1
            back = layer.T @ error
            layer -= now * np.outer(error, mean)
            bias -= 0.1 * now * error
            if len(ids):
                # shares are small, so each vector moves by its share of the text's features, as in the mean
                vectors[ids] -= now * np.outer(share * min(len(ids), 100), back)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(column))
    for a, b, groups in feature_slices(column):
        total, count = np.zeros(b - a), np.zeros(b - a)
        for f, g in groups:
            run = np.concatenate(([0.0], np.cumsum(table[f], dtype=np.float64)))
            total += run[g[1:]] - run[g[:-1]]
            count += np.diff(g)
        z = np.clip(total / np.maximum(count, 1) + bias, -500, 500)
        out[a:b] = 1 / (1 + np.exp(-z))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, bound: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    Labels are learned from rows outside the held-out fold only, from the text
    alone. A null or empty text has the score of the bias; rows without doc_id
    are scored and not held out; repeated rows are scored alike, one by one;
    extra columns are ignored; without labels every score is 0.5.
    """
    sample = labelled_texts(docs, labels, "quality", folds, held_out, bound)
    table, bias = train(sample.column("text").combine_chunks(), sample.column("label").to_numpy())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(2), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
