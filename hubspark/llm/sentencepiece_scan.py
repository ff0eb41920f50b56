"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is segmented into vocabulary pieces of the greatest total score. Over
the max-plus semiring a stretch of text is a matrix: entry (e, o) is the best
score of a path that enters with its first e bytes already covered and leaves
with a piece reaching o bytes beyond its end. Matrices combine associatively,
so a long text is cut anywhere; the parts' matrices are found in parallel,
combined, and once each part's entry and exit are known it is traced back on
its own. Where a space follows another character every path has a boundary
(pieces hold spaces only at their head), the matrix is the outer product of two vectors,
and the stretch between two such places is solved alone, each distinct one once.

The space stands for the model's U+2581, so bytes of the text are matched as
they are and a literal U+2581 is spelled in byte pieces: decoding gives back
every text exactly. Scores are integers, so no order of combination changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Table, U, constants, mix, slices
from .textops import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches without a sure boundary up to this many bytes are solved at once, longer ones by chunks of it.
CHUNK = 128
#: Texts of more bytes than this are cut into parts of it, which different tasks solve.
PART = 64 * 1024
SPACE = 0x20
LOW = -(1 << 50)
#: Score of a byte piece: below that of any path of other pieces over the same character.
BYTE_SCORE = -40_000

#: Cost of each piece besides its rank's; with it most words get the pieces that merging gives.
PIECE_COST = 5_000

_T, _P = constants(41, 256), constants(43, 256)


@dataclass
class Vocabulary:
    """Pieces as bytes, their integer scores, and a table by hash of the reversed bytes."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    table: Table
    ids: np.ndarray
    lengths: list[int]

    @property
    def reach(self) -> int:
        """Bytes of the longest piece; a path can lie in ``reach`` states at a cut."""
        return self.lengths[-1]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in self.pieces])
        return np.frombuffer(b"".join(self.pieces), dtype=np.uint8), np.concatenate(([0], np.cumsum(size)))


def vocabulary(pieces: list[tuple[bytes, int]], byte_ids: list[int]) -> Vocabulary:
    """From (bytes, score) by id and the ids of the 256 byte pieces; pieces of score None are never used."""
    usable = [i for i, (p, s) in enumerate(pieces) if p and s is not None]
    keys = np.array([int(_reversed_hash(np.frombuffer(pieces[i][0], dtype=np.uint8))) for i in usable], dtype=U)
    order = np.argsort(keys)
    scores = np.array([BYTE_SCORE if s is None else s for _, s in pieces], dtype=np.int64)
    return Vocabulary([p for p, _ in pieces], scores, np.array(byte_ids), Table(keys), np.array(usable)[order], sorted({len(pieces[i][0]) for i in usable} | {1}))


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file.

    The public file is a BPE model: its scores are merge ranks, not log
    probabilities, and no additive score gives the greedy merges. A piece of
    rank r has the score -1000 ln(r + 2), Zipf's law, less PIECE_COST, which
    prefers few pieces as merging does.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    plain = 0
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            pieces.append((bytes([int(text[3:5], 16)]), None))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append((b"", None))
        else:
            body = text.replace("▁", " ").encode()
            if b" " in body.lstrip(b" "):
                raise ValueError("a piece has a space after another character; stretches between spaces would not be independent")
            pieces.append((body, -round(1000 * float(np.log(plain + 2))) - PIECE_COST))
            plain += 1
    return vocabulary(pieces, byte_ids)


def _reversed_hash(data: np.ndarray) -> np.uint64:
    return mix((_T[data[::-1]] * _P[: len(data)]).sum(dtype=U, keepdims=True) + U(len(data)))[0]


def _arcs(v: Vocabulary, data: np.ndarray, ends: np.ndarray, most: np.ndarray | int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, lanes, ids, scores) of the pieces that end at ``ends`` and have up to ``most`` bytes, shortest first."""
    acc = np.zeros(len(ends), dtype=U)
    most = np.broadcast_to(most, ends.shape)
    longest = int(most.max()) if len(ends) else 0
    wanted = set(v.lengths)
    lanes = np.arange(len(ends))
    for n in range(1, min(longest, v.reach) + 1):
        if n > 1:
            ok = most[lanes] >= n
            lanes, acc = lanes[ok], acc[ok]
        at = ends[lanes] - n
        acc = acc + _T[data[at]] * _P[n - 1]
        if n not in wanted:
            continue
        found = v.table.find(mix(acc + U(n)))
        if n == 1:
            ids = np.where(found >= 0, v.ids[np.maximum(found, 0)], v.byte_ids[data[at]])
            yield n, lanes, ids, np.where(found >= 0, v.scores[ids], BYTE_SCORE)
        else:
            hit = found >= 0
            if hit.any():
                ids = v.ids[found[hit]]
                yield n, lanes[hit], ids, v.scores[ids]


def solve_lanes(v: Vocabulary, data: np.ndarray, base: np.ndarray, end: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds per lane) of the best paths from ``base`` to ``end + over``, all lanes in lockstep.

    Pieces start before ``end``; with ``over`` the last one reaches beyond it by
    just so much. Of paths with equal scores the one with the shortest last piece is taken.
    """
    order = np.argsort(base - end, kind="stable")  # longest first: the lanes that go on are always a prefix
    base, end, over = base[order], end[order], over[order]
    length = end - base
    width = length + 1 + (over > 0)
    first = np.concatenate(([0], np.cumsum(width)))
    best = np.full(int(first[-1]), LOW, dtype=np.int64)
    back = np.zeros(int(first[-1]), dtype=np.int32)
    piece = np.zeros(int(first[-1]), dtype=np.int32)
    best[first[:-1]] = 0
    for t in range(1, int(length.max(initial=0)) + 1):
        n = int(np.searchsorted(-length, -t, "right"))
        node = first[:n] + t
        top, size, which = np.full(n, LOW, dtype=np.int64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        for k, lanes, ids, scores in _arcs(v, data, base[:n] + t, t):
            value = best[node[lanes] - k] + scores
            better = value > top[lanes]
            lanes = lanes[better]
            top[lanes], size[lanes], which[lanes] = value[better], k, ids[better]
        best[node], back[node], piece[node] = top, size, which
    out = np.flatnonzero(over)
    if len(out):
        node = first[out] + length[out] + 1
        for k, lanes, ids, scores in _arcs(v, data, end[out] + over[out], length[out] + over[out]):
            starts = k > over[out][lanes]
            lanes, ids, scores = lanes[starts], ids[starts], scores[starts]
            value = best[first[out][lanes] + length[out][lanes] + over[out][lanes] - k] + scores
            better = value > best[node[lanes]]
            hit = node[lanes[better]]
            best[hit], back[hit], piece[hit] = value[better], k, ids[better]
    # trace back, one piece of every lane at a time
    lane = np.arange(len(base))
    at = length + over
    node = first[:-1] + length + (over > 0)
    lane_of, ids_of, steps = [], [], []
    step = 0
    while len(lane):
        go = at > 0
        lane, at, node = lane[go], at[go], node[go]
        if not len(lane):
            break
        lane_of.append(lane)
        ids_of.append(piece[node])
        steps.append(np.full(len(lane), -step))
        at = at - back[node]
        node = first[lane] + at
        step += 1
    if not lane_of:
        return np.zeros(0, dtype=np.int32), np.zeros(len(base) + 1, dtype=np.int64)
    lanes, ids, steps = np.concatenate(lane_of), np.concatenate(ids_of), np.concatenate(steps)
    o = np.lexsort((steps, order[lanes]))
    counts = np.bincount(order[lanes], minlength=len(base))
    return ids[o], np.concatenate(([0], np.cumsum(counts)))


def matrices(v: Vocabulary, data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(chunks, reach, reach): the transfer matrices of chunks of one size (at least ``reach``).

    ``data`` must go on for ``reach - 1`` bytes after a chunk, or end there: states beyond its end are not reachable.
    """
    w = v.reach
    scores = np.full((len(starts), size + w, w + 1), LOW, dtype=np.int64)  # by chunk, end, length
    ends = (starts[:, None] + np.arange(1, size + w)[None, :]).ravel()
    inside = ends <= len(data)
    lane = np.flatnonzero(inside)
    most = np.minimum(np.tile(np.arange(1, size + w), len(starts)), w)
    for n, lanes, _, value in _arcs(v, data, ends[lane], most[lane]):
        flat = lane[lanes]
        scores[flat // (size + w - 1), flat % (size + w - 1) + 1, n] = value
    best = np.full((len(starts), w, size + w), LOW, dtype=np.int64)
    best[:, np.arange(w), np.arange(w)] = 0
    for t in range(1, size + w):
        for n in range(max(1, t - size + 1), min(t, w) + 1):
            np.maximum(best[:, :, t], best[:, :, t - n] + scores[:, t, n][:, None], out=best[:, :, t])
    return best[:, :, size:]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    out = np.full_like(a, LOW)
    for j in range(a.shape[-1]):
        np.maximum(out, a[..., :, j, None] + b[..., None, j, :], out=out)
    return np.maximum(out, LOW)


def reduce_all(m: np.ndarray) -> np.ndarray:
    """Product of a stack, by halves: the order of combination is free."""
    while len(m) > 1:
        even = len(m) // 2 * 2
        half = combine(m[0:even:2], m[1:even:2])
        m = np.concatenate((half, m[even:]))
    return m[0]


def routes(m: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the best path; of equally good places the least is taken.

    A tree: products of neighbours up to the root, then the place between the
    halves of each node, all nodes of a level at once.
    """
    levels = [np.stack(m)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        even = len(x) // 2 * 2
        levels.append(np.concatenate((combine(x[0:even:2], x[1:even:2]), x[even:])))
    came, left = np.array([entry]), np.array([leave])
    for x in reversed(levels[:-1]):
        n = len(x) // 2
        at = np.arange(n)
        between = (x[0 : 2 * n : 2][at, came[:n], :] + x[1 : 2 * n : 2][at, :, left[:n]]).argmax(axis=1)
        odd = slice(n, len(came))  # a node without a partner is its own parent
        came, left = (np.concatenate((np.stack(pair, axis=1).ravel(), rest)) for pair, rest in (((came[:n], between), came[odd]), ((between, left[:n]), left[odd])))
    return list(zip(came.tolist(), left.tolist(), strict=True))


def sure_bounds(data: np.ndarray) -> np.ndarray:
    """Places where every path has a boundary: before a space that follows another byte."""
    gap = data == SPACE
    return np.flatnonzero(gap[1:] & ~gap[:-1]) + 1


def _chunks(start: int, end: int, reach: int) -> np.ndarray:
    """Bounds of chunks of a long stretch: all of CHUNK bytes but the last, which has up to twice as many."""
    size = max(CHUNK, reach)
    return np.append(np.arange(start, max(end - size, start) + 1, size), end)


def _long(v: Vocabulary, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    size = max(CHUNK, v.reach)
    equal = cuts[:-2] if len(cuts) > 2 else cuts[:0]
    out = []
    for a in range(0, len(equal), 64):
        out.extend(matrices(v, data, equal[a : a + 64], size))
    last = matrices(v, data, cuts[-2:-1], int(cuts[-1] - cuts[-2]))
    return [*out, *last]


def segment(v: Vocabulary, data: np.ndarray, bounds: np.ndarray, stops: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds per text) of texts in one byte array.

    Text i lies between bounds[i] and stops[i]; what follows up to bounds[i + 1]
    is only looked at. Its path enters at ``entry`` and leaves at ``leave``.
    """
    sure = sure_bounds(data)
    marks = np.unique(np.concatenate((sure, bounds[:-1], stops)))
    owner = np.searchsorted(bounds, marks, "right") - 1
    use = (owner < len(stops)) & (marks < stops[np.minimum(owner, len(stops) - 1)])
    start, text = marks[use], owner[use]
    end = marks[np.flatnonzero(use) + 1]
    head, tail = start == bounds[text], end == stops[text]
    first, over = np.where(head, entry[text], 0), np.where(tail, leave[text], 0)
    big = end - start > max(CHUNK, 2 * v.reach)
    # plain stretches: each distinct one once
    plain = np.flatnonzero(~big & (first == 0) & (over == 0))
    keys = _stretch_hashes(data, start[plain], end[plain])
    _, once, again = np.unique(keys, return_index=True, return_inverse=True)
    base, stop, out = start[plain][once], end[plain][once], np.zeros(len(once), dtype=np.int64)
    job = np.full(len(start), -1, dtype=np.int64)
    job[plain] = again
    count = np.ones(len(start), dtype=np.int64)
    extra = []
    n_jobs = len(once)
    for i in np.flatnonzero(job < 0).tolist():
        job[i] = n_jobs + len(extra)
        if big[i]:
            cuts = _chunks(int(start[i]), int(end[i]), v.reach)
            # nothing beyond the text's own bytes may be looked at
            view = data[: bounds[text[i] + 1]]
            way = routes(_long(v, view, cuts), int(first[i]), int(over[i]))
            extra += [(int(cuts[k]) + e, int(cuts[k + 1]), o) for k, (e, o) in enumerate(way)]
            count[i] = len(way)
        else:
            extra.append((int(start[i]) + int(first[i]), int(end[i]), int(over[i])))
    if extra:
        e = np.array(extra, dtype=np.int64)
        base, stop, out = np.concatenate((base, e[:, 0])), np.concatenate((stop, e[:, 1])), np.concatenate((out, e[:, 2]))
    ids, at = solve_lanes(v, data, base, stop, out)
    # jobs of each stretch, then their ids, in order
    total = np.concatenate(([0], np.cumsum(count)))
    jobs = np.repeat(job - total[:-1], count) + np.arange(int(total[-1]))
    size = np.diff(at)[jobs]
    ends = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(int(ends[-1])) + np.repeat(at[jobs] - ends[:-1], size)
    per = np.searchsorted(text, np.arange(len(stops) + 1))
    return ids[take], ends[total[per]]


def _stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from .kernels import word_hashes

    return word_hashes(data, start, end) ^ mix((end - start).astype(U))


def prefixed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with a space before it, as the model expects."""
    n = len(bounds) - 1
    out = np.full(len(data) + n, SPACE, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))] = data
    return out, bounds + np.arange(n + 1)


def decode_bytes(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the texts of id lists, without the space that encoding put first."""
    blob, at = v.joined()
    size = np.diff(at)[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = blob[np.arange(int(ends[-1])) + np.repeat(at[ids] - ends[:-1], size)]
    starts = ends[bounds]
    some = np.diff(starts) > 0
    head = starts[:-1][some]
    head = head[data[head] == SPACE] if len(head) else head
    keep = np.ones(len(data), dtype=bool)
    keep[head] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], kept[starts]


def encode_column(v: Vocabulary, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, bounds, round trip): an empty text has no ids."""
    for a, b, raw, bounds in slices(column):
        n = b - a
        data, wide = prefixed(raw, bounds)
        zero = np.zeros(n, dtype=np.int64)
        ids, at = segment(v, data, wide, wide[1:], zero, zero)
        some = np.diff(bounds) > 0
        keep = np.repeat(some, np.diff(at))
        at = np.concatenate(([0], np.cumsum(np.diff(at) * some)))
        ids = ids[keep]
        back, ends = decode_bytes(v, ids, at)
        same = np.diff(ends) == np.diff(bounds)
        if same.all():
            wrong = np.flatnonzero(back != raw)
            same[np.unique(np.searchsorted(bounds, wrong, "right") - 1)] = False
        yield a, b, ids, at, same


_ENCODED = "n_pieces bigint, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, v: Vocabulary, part: int = PART) -> DataFrame:
    """Per row: doc_id, n_pieces, ids, round_trip (decoding the ids gave the text's bytes).

    A null or empty text has no pieces; repeated rows are encoded one by one;
    extra columns are ignored. Texts of over ``part`` bytes are cut into parts
    that go to different tasks: their matrices (part by part), the routes
    through them (a group of matrices per text, some kB for each part), then their ids.
    """
    if part < v.reach:
        raise ValueError("a part must be at least as long as the longest piece")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(v)  # the vocabulary's size is fixed
    rows = docs.select("doc_id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, at, same in encode_column(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(same)],
                    names=["doc_id", "n_pieces", "ids", "round_trip"],
                )

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    done = rows.where(size <= part).mapInArrow(whole, f"doc_id {kind}, {_ENCODED}")
    return done.unionByName(_encode_giant(rows.where(size > part), kind, shared, v.reach, part))


def _encode_giant(rows: DataFrame, kind: str, shared, reach: int, part: int) -> DataFrame:
    text = F.concat(F.lit(b" "), F.encode("text", "UTF-8"))
    # the last part is never shorter than the longest piece: a short rest belongs to the part before it
    n = F.greatest(F.lit(1), F.floor((F.octet_length("text") + 1 - reach) / F.lit(part)).cast("int") + F.when((F.octet_length("text") + 1 - reach) % part > 0, 1).otherwise(0))
    bin_ = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("bin"), n.alias("n"))
    cuts = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda k: F.struct(k.alias("k"), F.when(k < F.col("n") - 1, F.lit(part)).otherwise(F.octet_length("bin") - k * part).alias("size"), F.substring("bin", k * part + 1, F.when(k < F.col("n") - 1, F.lit(part + reach - 1)).otherwise(F.octet_length("bin"))).alias("bytes")),
    )
    # ids of rows must be the same for both uses, so the parts are written
    parts = cut(bin_.select("row", "doc_id", F.explode(cuts).alias("p")).select("row", "doc_id", "p.k", "p.size", "p.bytes"))

    def flat(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [np.frombuffer(x, dtype=np.uint8) for x in batch.column(at).to_pylist()]
        return np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [part_matrix(shared.value, np.frombuffer(x, dtype=np.uint8), s).tobytes() for x, s in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "k", "m"])

    def route(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        m = [np.frombuffer(x, dtype=np.int64).reshape(reach, reach) for x in group.column("m").to_pylist()]
        way = routes(m, 0, 0)
        return pa.table({"row": group.column("row"), "k": group.column("k"), "entry": pa.array([e for e, _ in way], pa.int32()), "leave": pa.array([o for _, o in way], pa.int32())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch, 4)
            size, entry, leave = (batch.column(i).to_numpy().astype(np.int64) for i in (3, 5, 6))
            ids, at = segment(shared.value, data, bounds, bounds[:-1] + size, entry, leave)
            back = [shared.value.pieces[i] for i in ids.tolist()]
            same = []
            for i in range(len(size)):
                got = b"".join(back[at[i] : at[i + 1]])
                same.append(got == data[bounds[i] + entry[i] : bounds[i] + size[i] + leave[i]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(same)], names=["row", "doc_id", "k", "ids", "same"])

    found = parts.select("row", "k", "size", "bytes").mapInArrow(matrix, "row bigint, k int, m binary").groupBy("row").applyInArrow(route, "row bigint, k int, entry int, leave int")
    way = found.select(F.col("row").alias("_row"), F.col("k").alias("_k"), "entry", "leave")
    joined = parts.join(way, (F.col("row") == F.col("_row")) & (F.col("k") == F.col("_k"))).select("row", "doc_id", "k", "size", "bytes", "entry", "leave")
    ids = joined.mapInArrow(traced, f"row bigint, doc_id {kind}, k int, ids array<int>, same boolean")
    whole = ids.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"), F.min("same").alias("round_trip"))
    return whole.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")


def part_matrix(v: Vocabulary, data: np.ndarray, size: int) -> np.ndarray:
    """The transfer matrix of the first ``size`` bytes; the rest is what pieces may reach into."""
    w = v.reach
    sure = sure_bounds(data[: size + 1])
    sure = sure[(sure > 0) & (sure < size)]

    def stretch(a: int, b: int) -> np.ndarray:
        if b - a >= w:
            return reduce_all(np.stack(_long(v, data[: b + w - 1], _chunks(a, b, w))))
        return _short_matrix(v, data, a, b)

    if not len(sure):
        return stretch(0, size)
    # what lies between the first and the last sure boundary adds the same to every path, and is left out
    left, right = stretch(0, int(sure[0]))[:, 0], stretch(int(sure[-1]), size)[0, :]
    return np.maximum(left[:, None] + right[None, :], LOW)


def _short_matrix(v: Vocabulary, data: np.ndarray, a: int, b: int) -> np.ndarray:
    """As ``matrices``, for a stretch shorter than the longest piece: a path may enter at its end or beyond it."""
    w, n = v.reach, b - a
    out = np.full((w, w), LOW, dtype=np.int64)
    for e in range(w):
        if e >= n:
            out[e, e - n] = 0
            continue
        best = {e: 0}
        for t in range(e + 1, n + w):
            if a + t > len(data):
                break
            top = LOW
            for k, _, _, score in _arcs(v, data, np.array([a + t]), min(t - e, w)):
                if t - k < n and t - k in best:
                    top = max(top, best[t - k] + int(score[0]))
            if top > LOW:
                best[t] = top
        for o in range(w):
            if n + o in best:
                out[e, o] = best[n + o]
    return out


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text, ids out of the vocabulary raise."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(v)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[at[0] : at[-1]]
            data, ends = decode_bytes(shared.value, ids, at - at[0])
            blob = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blob[x:y].decode() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")
