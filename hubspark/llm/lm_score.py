"""Text scores by a weighted backoff automaton of word n-grams.

States are the empty context, words and word pairs. With n the counts of all
training texts, the arc of word w from state c has the weight

    p(w | c) = (n(cw) + k p(w | c')) / (n(c) + k)

where c' is the shorter context and the empty one has the add-one unigram with
one place for all unseen words. A state without an arc for w fails over to c'
with the weight k / (n(c) + k), so that every state's weights sum to one
(Dirichlet smoothing). Every n-gram of the corpus counts, once seen or often,
at any corpus size: there is no cut-off, cap or approximate count.

A text needs only the counts of its own n-grams. So texts are packed to blocks
of a bounded size, each block asks for the total counts of its distinct
n-grams, and one traversal of the block's part of the automaton gives the
scores. An n-gram, however frequent, is one key per block; keys are hashes, so
the buckets in which the blocks' counts meet are even, and their number
follows the corpus. What a block has to itself is not answered: its own count
is the total then, and a triple of which one pair is the block's own is not
even asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SLICE, U, constants, mix, slices, word_bounds, word_hashes
from .samples import remainder
from .textops import cut, shuffles_once

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Tokens of the corpus for each bucket in which counts meet.
BUCKET_TOKENS = 1 << 20
#: Weight of the shorter context, in tokens, for words after a word and after a pair.
PRIOR = {2: 3000.0, 3: 10.0}
END = U(0x9D39_247E_3377_6D41)
_MIX2 = constants(31, 2)
_CODEC = pa.Codec("zstd", 1)


def token_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, bounds per text); each text ends with END."""
    start, end, first = word_bounds(data, bounds)
    n = len(bounds) - 1
    out = np.full(len(start) + n, END, dtype=U)
    place = np.arange(len(start)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = word_hashes(data, start, end)
    return out, first + np.arange(n + 1)


def _squeeze(x: np.ndarray) -> bytes:
    """Size and compressed bytes; the leading bytes of small numbers take no room."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _expand(packed: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(packed[8:], n * width, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Increasing 64-bit keys as their differences."""
    return _squeeze(np.diff(keys, prepend=U(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_expand(packed, U), dtype=U)


_BLOCK = "block bigint, ids array<{kind}>, held array<boolean>, n_tokens bigint, sizes binary, words binary, codes binary"


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, held_out, text -> one row per block: sizes of its texts, its distinct words and each token's place among them."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    parts, size = [], 0

    def done() -> pa.RecordBatch:
        ids, held, tokens, sizes = zip(*parts, strict=True)
        sizes = np.concatenate(sizes)
        words, codes = np.unique(np.concatenate(tokens), return_inverse=True)
        as_list = lambda xs: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(xs))
        packed = [_squeeze(sizes.astype(np.int64)), pack_sorted(words), _squeeze(codes.astype(np.uint32))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), as_list(ids), as_list(held), pa.array([int(sizes.sum())]), *[pa.array([x], pa.binary()) for x in packed]],
            names=["block", "ids", "held", "n_tokens", "sizes", "words", "codes"],
        )

    for batch in batches:
        for a, b, data, bounds in slices(batch.column(2), min(block, SLICE)):
            if parts and size + len(data) > block:
                yield done()
                number, parts, size = number + 1, [], 0
            tokens, at = token_hashes(LOWER[data], bounds)
            parts.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), tokens, np.diff(at)))
            size += len(data)
    if parts:
        yield done()


class Texts:
    """The tokens of a block: hashes, and what is a training token."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.held = np.array(row["held"], dtype=bool)
        self.sizes = _expand(row["sizes"], np.int64)
        self.words, self.codes = unpack_sorted(row["words"]), _expand(row["codes"], np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.train = np.repeat(~self.held, self.sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(self.first[:-1], self.sizes)

    def own(self, codes: np.ndarray, kinds: int, places: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each kind in the block's training texts."""
        train = self.train if places is None else self.train[places]
        return np.bincount(codes[train], minlength=kinds)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the second words, distinct keys, kind of the pair at each of the places)."""
        places = np.flatnonzero(self.place >= 1)
        tokens = self.words[self.codes]
        keys, kind = np.unique(_pair(tokens[places - 1], tokens[places]), return_inverse=True)
        return places, keys, kind


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _MIX2[0] + b * _MIX2[1])


def _asked(block: int, order: int, keys: np.ndarray, own: np.ndarray, bits: int) -> pa.Table:
    """Sorted keys with their counts in the block, one row per bucket of keys."""
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(1, dtype=np.int64)
    ends = np.append(cuts[1:], len(keys))
    some = np.flatnonzero(ends > cuts)
    spans = list(zip(cuts[some].tolist(), ends[some].tolist(), strict=True))
    own = own.astype(U)
    return pa.table({
        "bucket": pa.array((order << 40) + some.astype(np.int64)),
        "block": pa.array(np.full(len(some), block, dtype=np.int64)),
        "ks": pa.array([pack_sorted(keys[a:b]) for a, b in spans], pa.binary()),
        "own": pa.array([_squeeze(own[a:b]) for a, b in spans], pa.binary()),
    })


_ASKED = "bucket bigint, block bigint, ks binary, own binary"
_ANSWER = "block bigint, bucket bigint, more binary, kinds bigint, tokens bigint"


def _ask_words_and_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            texts = Texts(row)
            yield from _asked(texts.block, 1, texts.words, texts.own(texts.codes, len(texts.words)), bits).to_batches()
            places, keys, kind = texts.pairs()
            yield from _asked(texts.block, 2, keys, texts.own(kind, len(keys), places), bits).to_batches()


def _answer(asked: pa.Table) -> pa.Table:
    """Per block: what the other blocks add to each of its keys, doubled, plus one if any other has the key; kinds and tokens of the bucket in its first row."""
    keys = [unpack_sorted(k) for k in asked.column("ks").to_pylist()]
    own = np.concatenate([_expand(n, U) for n in asked.column("own").to_pylist()])
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    ids, kind = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(kind, weights=own, minlength=len(ids)).astype(U)
    shared = np.bincount(kind, minlength=len(ids)) > 1
    more = np.where(shared[kind], (total[kind] - own) * U(2) + U(1), U(0))
    once = lambda n: pa.array([int(n)] + [0] * (len(keys) - 1), pa.int64())
    return pa.table({
        "block": asked.column("block"),
        "bucket": asked.column("bucket"),
        "more": pa.array([_squeeze(more[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
        "kinds": once((total > 0).sum()),
        "tokens": once(own.sum()),
    })


def _answers(told: pa.Table) -> dict[int, np.ndarray]:
    """Per order the answers of a block, in the order of its keys."""
    out = {}
    for row in told.sort_by("bucket").to_pylist():
        out.setdefault(row["bucket"] >> 40, []).append(_expand(row["more"], U))
    return {k: np.concatenate(v) for k, v in out.items()}


def _triples(texts: Texts, shared: np.ndarray, places: np.ndarray, keys: np.ndarray, kind: np.ndarray):
    """(places of the third words, distinct keys, kinds at the places, which kinds other blocks may have)."""
    of = np.zeros(len(texts.codes), dtype=np.int64)
    of[places] = kind
    third = np.flatnonzero(texts.place >= 2)
    left, right = of[third - 1], of[third]
    ids, first, at = np.unique(_pair(keys[left], keys[right]), return_index=True, return_inverse=True)
    return third, ids, at, (shared[left] & shared[right])[first]


def _ask_triples(block: pa.Table, told: pa.Table, bits: int) -> pa.Table:
    empty = pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "ks": pa.array([], pa.binary()), "own": pa.array([], pa.binary())})
    out = [empty]
    for row in block.to_pylist():
        texts = Texts(row)
        pairs = texts.pairs()
        if not len(pairs[0]):
            continue
        third, ids, at, ask = _triples(texts, (_answers(told)[2] & U(1)) > 0, *pairs)
        own = texts.own(at, len(ids), third)
        out.append(_asked(texts.block, 3, ids[ask], own[ask], bits))
    return pa.concat_tables(out)


def traverse(texts: Texts, counts: dict[int, np.ndarray], pairs: tuple, triples: tuple, n_tokens: int, n_kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(add-one log10 of each token, log10 of the automaton's weight on the way to it).

    All texts go from left to right at once; the state before a token is the
    pair before it. Of each token: the arc from that state if it has one, else
    the failure weight and the arc from the last word, else that one's failure
    weight too and the arc from the empty context.
    """
    n1 = counts[1][texts.codes].astype(np.float64)
    empty = (n1 + 1) / (n_tokens + n_kinds + 1)
    by_word = empty.copy()
    places, _, kind = pairs
    context = np.zeros(len(n1))
    context[places] = counts[2][kind]
    k = PRIOR[2]
    seen = n1[places - 1]  # every occurrence of a word but END goes on
    arc = context[places] > 0
    by_word[places] = np.where(arc, (context[places] + k * empty[places]) / (seen + k), k / (seen + k) * empty[places])
    out = by_word.copy()
    third, _, at, _ = triples
    k = PRIOR[3]
    n3, seen = counts[3][at].astype(np.float64), context[third - 1]
    out[third] = np.where(n3 > 0, (n3 + k * by_word[third]) / (seen + k), k / (seen + k) * by_word[third])
    return np.log10(empty), np.log10(out)


_SCORED = "doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(block: pa.Table, told: pa.Table, n_tokens: int, n_kinds: int) -> pa.Table:
    out = []
    for row, ids, held in zip(block.drop_columns(["ids"]).to_pylist(), block.column("ids"), block.column("held"), strict=True):
        texts, more = Texts(row), _answers(told)
        pairs = texts.pairs()
        shared = (more[2] & U(1)) > 0 if 2 in more else np.zeros(0, dtype=bool)
        triples = _triples(texts, shared, *pairs)
        third, keys, at, ask = triples
        counts = {1: texts.own(texts.codes, len(texts.words)), 2: texts.own(pairs[2], len(pairs[1]), pairs[0]), 3: texts.own(at, len(keys), third)}
        counts = {k: v.astype(np.int64) for k, v in counts.items()}
        for k, which in ((1, slice(None)), (2, slice(None)), (3, ask)):
            if k in more:
                counts[k][which] += (more[k] >> U(1)).astype(np.int64)
        base, score = traverse(texts, counts, pairs, triples, n_tokens, n_kinds)
        known = counts[1][texts.codes] > 0
        sums = [np.add.reduceat(x, texts.first[:-1]) for x in (known.astype(np.int64), base, score)]
        out.append(pa.table({"doc_id": ids.values, "held_out": held.values, "n_tokens": texts.sizes, "n_known": sums[0], "base_score": sums[1], "score": sums[2]}))
    return pa.concat_tables(out)


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, block: int = BLOCK, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows outside the held-out fold (a row without doc_id is one
    of them); a null text is empty and has only the end token; repeated rows
    are counted and scored one by one; extra columns are ignored. Without
    training texts nothing is known and both scores are 0. ``block`` and
    ``bucket_tokens`` change the work's cut and no result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    with shuffles_once(spark):
        blocks = cut(rows.mapInArrow(lambda it: _blocks(it, block), _BLOCK.format(kind=kind)))
        n_all = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        bits = max(4, (int(n_all) // bucket_tokens).bit_length())
        asked = blocks.mapInArrow(lambda it: _ask_words_and_pairs(it, bits), _ASKED)
        told = cut(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER))
        total = told.where(F.shiftright("bucket", 40) == 1).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
        n, v = int(total["n"]), int(total["v"])
        of_pairs = told.where(F.shiftright("bucket", 40) == 2).groupBy("block")
        triples = blocks.groupBy("block").cogroup(of_pairs).applyInArrow(lambda b, t: _ask_triples(b, t, bits), _ASKED)
        told3 = cut(triples.groupBy("bucket").applyInArrow(_answer, _ANSWER))
    scored = blocks.groupBy("block").cogroup(told.unionAll(told3).groupBy("block")).applyInArrow(lambda b, t: _score(b, t, n, v), _SCORED.format(kind=kind))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
