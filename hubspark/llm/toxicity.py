"""Toxicity with noisy-channel deobfuscation.

Tokens that look disguised (digits or signs among letters, letters apart,
drawn-out letters) become lattices: each character may stand for itself, for
the letters it is used for, for nothing (a separator) or for one or two of a
run. A Viterbi search under a character trigram model of the corpus' plain
words picks the likeliest spelling. The restored text is then scored by word
evidence learned from labels, with back-off from a word to its beginnings, so
that inflected forms share what is known of their stem.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U, _byte_table, _place_table, mix, shingles, slices, word_bounds, word_hashes
from .samples import labelled_texts, remainder

#: Labelled rows used for training: the documented bound.
MAX_TRAIN = 8000
#: Bytes of texts the driver looks at in one pass while it trains.
TRAIN_SLICE = 1 << 18
#: Lengths in bytes of the word beginnings that share evidence.
STEMS = (3, 4, 5, 6, 8)
#: Weight of the shorter beginning's evidence, least evidence that counts, and what a word without evidence takes off.
PRIOR, LEAST, PLAIN = 20.0, 1.7, 0.006
#: Likelihood ratio statistic that a word or beginning must reach to be evidence; among a million words about ten would by chance.
SURE = 20.0

#: Letters that digits and signs are used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Signs put between letters.
BETWEEN = ".-_*~'`^,:;/\\ \t"
#: Log costs of the channel: a sign for a letter, a digit for itself, a sign for nothing, a repetition typed once too often or drawn out.
SWAP, ITSELF, NOTHING, TWICE = -1.0, -4.0, -8.0, -1.0

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LATIN = np.zeros(256, dtype=bool)
_LATIN[97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LEET]] = True
_APART = np.zeros(256, dtype=bool)
_APART[[ord(c) for c in BETWEEN]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of the Latin-1 block."""
    out = LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero(out[:-1] == 0xC3) + 1
        at = second[(out[second] >= 0x80) & (out[second] <= 0x9E) & (out[second] != 0x97)]
        out[at] += 0x20
    return out


@dataclass
class CharModel:
    """Character trigrams with back-off to bigrams and single characters, by absolute discounting."""

    grams: list[dict] = field(default_factory=lambda: [{}, {}, {}])
    totals: list[dict] = field(default_factory=lambda: [{}, {}, {}])
    kinds: list[dict] = field(default_factory=lambda: [{}, {}, {}])
    known: dict = field(default_factory=dict)

    @classmethod
    def of(cls, codes: np.ndarray, weights: np.ndarray) -> CharModel:
        """From trigram codes (three code points, 21 bits each) and their weights."""
        m = cls()
        for code, n in zip(codes.tolist(), weights.tolist(), strict=True):
            key = "".join(chr(code >> 21 * k & 0x1FFFFF) for k in (2, 1, 0))
            for order in range(3):
                m.grams[order][key[2 - order :]] = m.grams[order].get(key[2 - order :], 0.0) + n
        for order in range(3):
            for key, n in m.grams[order].items():
                c = key[:-1]
                m.totals[order][c] = m.totals[order].get(c, 0.0) + n
                m.kinds[order][c] = m.kinds[order].get(c, 0) + 1
        return m

    def logp(self, context: str, c: str) -> float:
        key = context + c
        if key not in self.known:
            p = 1e-4
            for order in range(3):
                ctx = context[2 - order :]
                if total := self.totals[order].get(ctx):
                    d = min(0.75, total / (self.kinds[order][ctx] + 1))
                    p = max(self.grams[order].get(ctx + c, 0.0) - d, 0.0) / total + d * self.kinds[order][ctx] / total * p
            self.known[key] = math.log(max(p, 1e-12))
        return self.known[key]


def restore(token: str, model: CharModel) -> str:
    """The likeliest plain spelling of a disguised token."""
    runs: list[list] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    states = {"^^": (0.0, None)}
    for c, n in runs:
        if c in BETWEEN:
            options = [("", 0.0)]
        elif c in LEET:
            options = [(x * k, k * SWAP + (k > 1) * TWICE) for x in LEET[c] for k in ({1} if n == 1 else {1, 2})]
            options += [(c * min(n, 2), ITSELF)] if c.isdigit() else [("", NOTHING)]
        else:
            options = [(c, 0.0)] if n == 1 else [(c, TWICE), (c * 2, 0.0 if n == 2 else TWICE)]
        after: dict = {}
        for context, (score, back) in states.items():
            for text, cost in options:
                s, ctx = score + cost, context
                for x in text:
                    s += model.logp(ctx, x)
                    ctx = ctx[1] + x
                if ctx not in after or s > after[ctx][0]:
                    after[ctx] = (s, (back, text))
        states = after
    _, back = max(((s + model.logp(ctx, "$"), b) for ctx, (s, b) in states.items()), key=lambda x: x[0])
    parts = []
    while back is not None:
        back, text = back
        parts.append(text)
    return "".join(reversed(parts))


def disguised(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str]]:
    """(text, token) of what looks disguised, from lower-cased bytes."""
    n = len(data)
    if n < 3:
        return
    letter, latin, sign, space = _LETTER[data], _LATIN[data], _SIGN[data], _SPACE[data]
    spots = np.zeros(n, dtype=bool)
    # whether a byte and the next are of one text: what a text's neighbours hold must not matter
    same = np.ones(n - 1, dtype=bool)
    inner = bounds[1:-1]
    same[inner[(inner > 0) & (inner < n)] - 1] = False
    # a sign or digit before a letter, or a single one that ends a token after a letter
    spots[:-1] |= sign[:-1] & letter[1:] & same
    ends = np.ones(n, dtype=bool)
    ends[:-1] = space[1:] | ~same
    digit = ((data >= 48) & (data <= 57)) | (data == 36) | (data == 64)
    spots[1:] |= digit[1:] & letter[:-1] & same & ends[1:]
    # a letter drawn out to three or more
    spots[2:] |= latin[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & same[1:] & same[:-1]
    # letters (or signs) one by one between separators
    if n >= 5:
        one, sep = latin | sign, _APART[data]
        before = np.ones(n, dtype=bool)
        before[1:] = ~(letter[:-1] | sign[:-1]) | ~same
        row = one[:-4] & sep[1:-3] & one[2:-2] & sep[3:-1] & one[4:] & before[:-4]
        apart = np.flatnonzero(row)
    else:
        apart = np.zeros(0, dtype=np.int64)
    done = -1
    for at in apart.tolist():
        if at < done:
            continue
        text = int(np.searchsorted(bounds, at, "right")) - 1
        end, stop = at, int(bounds[text + 1])
        while end + 2 < stop and _APART[data[end + 1]] and (latin[end + 2] or sign[end + 2]) and (end + 3 >= stop or not (letter[end + 3] or sign[end + 3])):
            end += 2
        done = end
        if end - at >= 4:
            yield text, data[at : end + 1].tobytes().decode("utf-8", "replace")
    at = np.flatnonzero(spots)
    if not len(at):
        return
    start, end, first = word_bounds(data, bounds)
    for w in np.unique(np.searchsorted(start, at, "right") - 1).tolist():
        token = data[start[w] : end[w]].tobytes().decode("utf-8", "replace").rstrip("!?.,;:)\"'").lstrip("(\"'")
        if token:
            yield int(np.searchsorted(first, w, "right")) - 1, token


def stem_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Per length of STEMS the hash of each word's beginning (0: the word is not longer), then that of the word."""
    out, acc = [], np.zeros(len(start), dtype=U)
    table, place, length = _byte_table(), _place_table(16), end - start
    last = len(data) - 1
    for j in range(max(STEMS)):
        acc = acc + table[data[np.minimum(start + j, last)]] * place[j]
        if j + 1 in STEMS:
            h = mix(acc + U(j + 1)) | U(1)
            h[length <= j + 1] = 0
            out.append(h)
    return [*out, word_hashes(data, start, end) | U(1)]


@dataclass
class Model:
    """Log odds of a document, evidence of words and beginnings (sorted by hash), and the spelling model."""

    prior: float
    keys: np.ndarray
    values: np.ndarray
    chars: CharModel
    quick: np.ndarray

    def evidence(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per word the value of its longest known part; 0 without any."""
        out = np.zeros(len(start))
        if not len(start) or not len(self.keys):
            return out
        for h in stem_hashes(data, start, end):
            some = np.flatnonzero(self.quick[(h >> U(46)).astype(np.int64)] & (h > 0))
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = self.keys[at] == h[some]
            out[some[hit]] = self.values[at[hit]]
        return out


def _words_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the string of each word."""
    joined = [s.encode() for s in strings]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in joined]))).astype(np.int64)
    data = lower(np.frombuffer(b"".join(joined), dtype=np.uint8))
    start, end, first = word_bounds(data, bounds, SEPARATOR)
    return data, start, end, np.repeat(np.arange(len(strings)), np.diff(first))


def trigram_codes(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of alphabetic words with stops, and their weights.

    Words weigh by the root of their count, so that rare spellings are not drowned.
    """
    use = [k for k, w in enumerate(words) if w.isalpha()]
    if not use:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    text = np.frombuffer("".join(f"^^{words[k]}$" for k in use).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    length = np.array([len(words[k]) + 3 for k in use])
    place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
    at = np.flatnonzero(place >= 2)
    codes = (text[at - 2] << 42) | (text[at - 1] << 21) | text[at]
    ids, back = np.unique(codes, return_inverse=True)
    return ids, np.bincount(back, weights=np.repeat(np.sqrt(counts[use]), length)[at])


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, back = np.unique(np.concatenate(keys), return_inverse=True)
    return ids, np.bincount(back, weights=np.concatenate(values), minlength=len(ids))


def spelling_of(texts: pa.Array) -> CharModel:
    """The spelling model of the words of texts, slice by slice."""
    codes, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for _, _, data, bounds in slices(texts):
        data = lower(data)
        start, end, _ = word_bounds(data, bounds, SEPARATOR)
        _, once, n = np.unique(word_hashes(data, start, end), return_index=True, return_counts=True)
        blob = data.tobytes()
        k, w = trigram_codes([blob[a:b].decode("utf-8", "replace") for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)], n)
        k, w = _summed([codes[-1], k], [weights[-1], w])
        codes, weights = [k], [w]
    return CharModel.of(codes[0], weights[0])


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct alphabetic words of each slice with their counts."""
    for batch in batches:
        for _, _, data, bounds in slices(batch.column(0)):
            data = lower(data)
            start, end, _ = word_bounds(data, bounds, SEPARATOR)
            _, once, n = np.unique(word_hashes(data, start, end), return_index=True, return_counts=True)
            blob = data.tobytes()
            words = [blob[a:b].decode("utf-8", "replace") for a, b in zip(start[once].tolist(), end[once].tolist(), strict=True)]
            use = np.array([w.isalpha() for w in words], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, u in zip(words, use.tolist(), strict=True) if u], pa.string()), pa.array(n[use].astype(np.int64))], names=["word", "n"])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram codes of words; weights in 1024ths, as integers, so that sums do not depend on the order."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        codes, weights = trigram_codes(batch.column(0).to_pylist(), np.round(1024 * np.sqrt(n)) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.round(weights).astype(np.int64))], names=["code", "weight"])


def corpus_spelling(docs: DataFrame) -> CharModel:
    """The spelling model of all distinct words of all documents; no label is needed. Only trigrams reach the driver."""
    words = docs.select("text").mapInArrow(_plain_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    t = words.mapInArrow(_trigrams, "code bigint, weight bigint").groupBy("code").agg(F.sum("weight").alias("weight")).toArrow().sort_by("code")
    return CharModel.of(t.column("code").to_numpy(), t.column("weight").to_numpy() / 1024)


class Evidence:
    """Per distinct word: hashes of its beginnings, and how many toxic and other documents hold it."""

    def __init__(self):
        self.h, self.t, self.c = np.zeros((len(STEMS) + 1, 0), dtype=U), np.zeros(0), np.zeros(0)

    def add(self, h: np.ndarray, toxic: np.ndarray) -> None:
        """Columns of hashes, one per document and word."""
        h = np.concatenate((self.h, h), axis=1)
        _, at, back = np.unique(h[-1], return_index=True, return_inverse=True)
        self.t = np.bincount(back, weights=np.concatenate((self.t, toxic)), minlength=len(at))
        self.c = np.bincount(back, weights=np.concatenate((self.c, 1.0 - toxic)), minlength=len(at))
        self.h = h[:, at]


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, base: float) -> np.ndarray:
    """Twice the log likelihood ratio of a in a + b against the base rate; 0 where it is below that rate."""
    n = a + b
    share = a / n
    high = np.where(a > 0, a * np.log(np.maximum(share, 1e-300) / base), 0.0) + np.where(b > 0, b * np.log(np.maximum(1 - share, 1e-300) / (1 - base)), 0.0)
    return np.where(share > base, 2 * high, 0.0)


def unlike(texts: pa.Array, label: np.ndarray) -> np.ndarray:
    """Rows without near copies of an earlier row of the same label, whose words would count as evidence many times.

    Texts with the same least hash of three-word runs count as near copies.
    """
    least = np.zeros(len(texts), dtype=U)
    for a, b, data, bounds in slices(texts, TRAIN_SLICE):
        data = lower(data)
        start, end, first = word_bounds(data, bounds, SEPARATOR)
        values, at = shingles(word_hashes(data, start, end), first, 3)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            least[a + some] = np.minimum.reduceat(values, at[:-1][some])
    _, rows = np.unique(np.stack((least, label.astype(U))), axis=1, return_index=True)
    return np.sort(rows)


def train(texts: pa.Array, label: np.ndarray, chars: CharModel | None = None) -> Model:
    """Evidence from how many toxic and other documents hold each word; one class only, or no rows: no evidence.

    The spelling model is that of the texts unless one is given.
    """
    label = np.asarray(label) == 1
    rows = unlike(texts, label)
    texts, label = texts.take(pa.array(rows)), label[rows]
    chars = spelling_of(texts) if chars is None else chars
    seen = Evidence()
    for a, b, data, bounds in slices(texts, TRAIN_SLICE):
        data = lower(data)
        start, end, first = word_bounds(data, bounds, SEPARATOR)
        parts, owner = [stem_hashes(data, start, end)], [np.repeat(np.arange(b - a), np.diff(first))]
        found = list(disguised(data, bounds))
        if found:
            d, s, e, who = _words_of([restore(t, chars) for _, t in found])
            if len(s):
                parts.append(stem_hashes(d, s, e))
                owner.append(np.array([x for x, _ in found])[who])
        h, o = np.concatenate([np.stack(p) for p in parts], axis=1), np.concatenate(owner)
        once = _first_of(o, h[-1])
        seen.add(h[:, once], label[o[once] + a].astype(float))
    n1 = int(label.sum())
    n0 = len(label) - n1
    prior = math.log((n1 + 0.5) / (n0 + 0.5))
    keys: dict[int, float] = {}
    h, t, c = seen.h, seen.t, seen.c
    if n1 and n0 and t.sum() and c.sum():
        base = t.sum() / (t.sum() + c.sum())
        q, under = np.full(len(t), base), np.zeros(len(t), dtype=bool)
        odds = lambda p: np.log(p / (1 - p)) - math.log(base / (1 - base))
        for level in h:
            has = level > 0
            ids, back = np.unique(level[has], return_inverse=True)
            a = np.bincount(back, weights=t[has], minlength=len(ids))
            b = np.bincount(back, weights=c[has], minlength=len(ids))
            q[has] = (a[back] + PRIOR * q[has]) / (a[back] + b[back] + PRIOR)
            r = odds(q[has])
            sure = _likelihood_ratio(a, b, base)[back] > SURE
            told = (r > LEAST) & (sure | under[has])
            tell = under[has] | told
            keys.update(zip(level[has][tell].tolist(), np.where(told, r, 0.0)[tell].tolist(), strict=True))
            under[has] |= told
    order = np.array(sorted(keys), dtype=U)
    quick = np.zeros(1 << 18, dtype=bool)
    quick[(order >> U(46)).astype(np.int64)] = True
    return Model(prior, order, np.array([keys[int(k)] for k in order]), chars, quick)


def _first_of(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First place of each (owner, h)."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    first = np.ones(len(o), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return order[first]


def score_texts(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of distinct telling words) of each text."""
    scores, tells = np.empty(len(column)), np.empty(len(column), dtype=np.int32)
    cache: dict[str, list[tuple[bytes, float]]] = {}
    for a, b, data, bounds in slices(column):
        data = lower(data)
        start, end, first = word_bounds(data, bounds, SEPARATOR)
        value = model.evidence(data, start, end)
        found: list[dict] = [{} for _ in range(b - a)]
        at = np.flatnonzero(value > 0)
        for i, w in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist(), strict=True):
            found[i][data[start[w] : end[w]].tobytes()] = value[w]
        for i, token in disguised(data, bounds):
            if token not in cache:
                d, s, e, _ = _words_of([restore(token, model.chars)])
                v = model.evidence(d, s, e)
                if len(cache) > 100_000:
                    cache.clear()
                cache[token] = [(d[x:y].tobytes(), r) for x, y, r in zip(s.tolist(), e.tolist(), v.tolist(), strict=True) if r > 0]
            found[i].update(cache[token])
        total = np.array([sum(x.values()) for x in found]) - (PLAIN if len(model.keys) else 0.0) * np.diff(first) + model.prior
        scores[a:b] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        tells[a:b] = [len(x) for x in found]
    return scores, tells


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bound: int = MAX_TRAIN):
    """The model as a broadcast variable; its size is bounded by the sample's and the trigram alphabet's."""
    chars = corpus_spelling(docs)  # before the sample comes, so that the driver holds one of both at a time
    model = train(*_sample(docs, labels, folds, held_out, bound), chars)
    model.chars.known.clear()
    pa.default_memory_pool().release_unused()
    return docs.sparkSession.sparkContext.broadcast(model)


def _sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, bound: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the sample without near copies, so that the rest is free when training starts."""
    sample = labelled_texts(docs, labels, "toxic", folds, held_out, bound)
    texts, label = sample.column("text").combine_chunks(), sample.column("label").to_numpy()
    rows = unlike(texts, label == 1)
    return texts.take(pa.array(rows)), label[rows]


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, bound: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted and n_telling (distinct words with evidence).

    Labels are learned from rows outside the held-out fold only, from the text
    alone. A null or empty text has the score of the prior; rows without doc_id
    are scored and not held out; repeated rows are scored alike, one by one;
    extra columns are ignored; without labels every score is 0.5.
    """
    shared = fit(docs, labels, folds, held_out, bound)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, tells = score_texts(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(tells)], names=["doc_id", "held_out", "score", "predicted", "n_telling"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int, n_telling int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, judged where they are read."""
    shared = fit(docs, labels, **how)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = score_texts(batch.column(at), shared.value)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(kept, docs.schema)
