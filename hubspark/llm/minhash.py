"""Near-duplicate classes by min-max hashing.

Each hash function gives a text two signature values, the least and the
greatest hash of its shingles (Ji et al. 2013), so that a signature of 2m
values costs m evaluations. Bands of values form buckets; texts that share a
bucket are candidates, and their full shingle sets decide.

No bucket is turned into pairs. Texts with equal sets are one representative;
buckets are joined to clusters by stars (member, least member). A small
cluster's sets meet in one task, where one matrix product counts all
intersections and only a star (member, least member) for each linked class leaves the task. In a
large cluster all sets are first held against one of them, the pivot; those
linked to it need not meet each other. The rest is dealt by size: linked sets
differ in size by less than the similarity allows, so only blocks of the same
and of neighbouring size classes meet. Both cuts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import LOWER, U, constants, distinct_sorted, mix, shingles, slices, word_bounds, word_hashes
from .textops import cut, shuffles_once

SHINGLE = 5
#: With 66 functions in 22 bands of 6 values a pair of similarity 0.85 shares no band with a chance of 3e-5.
FUNCTIONS = 66
BAND = 6
#: Mean number of texts in a block of a large cluster; two blocks meet in a task.
BLOCK = 1000


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds): the sorted distinct shingle hashes of each text."""
    for a, b, data, bounds in slices(column):
        data = LOWER[data]
        start, end, first = word_bounds(data, bounds)
        values, at = shingles(word_hashes(data, start, end), first, k)
        yield a, b, *distinct_sorted(values, at)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(values, dtype=U)))
    return total[bounds[1:]] - total[bounds[:-1]]


def signature(values: np.ndarray, bounds: np.ndarray, functions: int) -> np.ndarray:
    """(texts, 2 * functions): least and greatest value of each function; texts must not be empty."""
    out = np.empty((len(bounds) - 1, 2 * functions), dtype=U)
    for j, a in enumerate(constants(7, functions)):
        hashed = values * a
        out[:, 2 * j] = np.minimum.reduceat(hashed, bounds[:-1])
        out[:, 2 * j + 1] = np.maximum.reduceat(hashed, bounds[:-1])
    return out


def bands(signatures: np.ndarray, width: int) -> np.ndarray:
    """(texts, bands): one key per band; the band's number is part of it."""
    n = signatures.shape[1] // width
    weights = constants(11, n * width).reshape(n, width)
    keys = np.empty((len(signatures), n), dtype=U)
    for j in range(n):
        keys[:, j] = mix((signatures[:, j * width : (j + 1) * width] * weights[j]).sum(axis=1, dtype=U) + U(j))
    return keys


def _signed(batches: Iterator[pa.RecordBatch], k: int, functions: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b, values, bounds in shingle_sets(texts, k):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            keys = np.zeros((0, 0), dtype=U)
            if len(some):
                tight = np.concatenate((bounds[:-1][some], bounds[-1:]))
                keys = bands(signature(values, tight, functions), width)
            per = keys.shape[1] if len(some) else 0
            sizes = np.zeros(b - a, dtype=np.int32)
            sizes[some] = per
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array(n.astype(np.int64)),
                    pa.array(segment_sums(values, bounds).view(np.int64)),
                    pa.array(segment_sums(mix(values + U(1)), bounds).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )


#: Bits in the map of the texts whose sets are needed. A fuller map reads more texts twice and changes no result.
MAP_BITS = 27


def bit_map(hashes: Column, rows: DataFrame, n: int) -> np.ndarray:
    """Map over the leading bits of about n 64-bit hashes; its words are put together before they reach the driver, 2 ** (MAP_BITS - 6) at most."""
    bits = min(MAP_BITS, max(10, n.bit_length() + 4))
    at = F.shiftrightunsigned(hashes, 64 - bits)
    words = rows.select(F.shiftright(at, 6).alias("place"), (at % 64).cast("int").alias("bit")).groupBy("place").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[words.column("place").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch], k: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, hash of id and text -> id, s1, s2 and set, where the hash is in the map."""
    bits = U(64 - (len(wanted).bit_length() + 2))
    for batch in batches:
        at = batch.column(1).to_numpy().view(U) >> bits
        rows = np.flatnonzero((wanted[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1))
        ids, texts = batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows))
        for a, b, values, bounds in shingle_sets(texts, k):
            one, two = segment_sums(values, bounds).view(np.int64), segment_sums(mix(values + U(1)), bounds).view(np.int64)
            packed = [values[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(one), pa.array(two), pa.array(packed, pa.binary())], names=["id", "t1", "t2", "set"])


def _near_pivot(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """id, pivot and both sets -> (id, pivot) of those that are linked."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set").to_pylist(), batch.column("pivot_set").to_pylist(), strict=True):
            both = len(np.intersect1d(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U), assume_unique=True))
            ok.append(100 * both >= need * ((len(x) + len(y)) // 8 - both))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(keep), batch.column("pivot").take(keep)], names=["a", "b"])


def block_links(ids: list, sets: list[np.ndarray], side: np.ndarray, need: int, near: np.ndarray | None = None) -> list[tuple]:
    """(member, least member) of each class of the pairs with 100 * intersection >= need * union; the least comes first in ``ids``.

    side: 0 and 1 for the two blocks that meet, 2 for all where a block meets
    itself. Pairs within one of two sides are another task's. near: sets that
    are linked with the pivot, so that pairs of them add nothing.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    use = often[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((m, m), dtype=np.float32)
    width = int(often.sum())
    step = 4096
    for a in range(0, width, step):
        i, j = np.searchsorted(column, (a, a + step))
        part = np.zeros((m, min(step, width - a)), dtype=np.float32)
        part[row[i:j], column[i:j] - a] = 1
        touched = np.flatnonzero(part.any(axis=1))
        part = part[touched]
        shared[np.ix_(touched, touched)] += part @ part.T
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(m):
        both = shared[i, i + 1 :].astype(np.int64)
        ok = 100 * both >= need * (sizes[i] + sizes[i + 1 :] - both)
        if side[i] != 2:
            ok &= side[i + 1 :] != side[i]
        if near is not None and near[i]:
            ok &= ~near[i + 1 :]
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(ids[i], ids[find(i)]) for i in range(m) if find(i) != i]


def _linked(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (cluster, task) -> links; a group may go over several batches."""
    key, rows, kind = None, [], None

    def done() -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        ids, sets, sides, near = zip(*rows, strict=True)
        found = block_links(ids, [np.frombuffer(x, dtype=U) for x in sets], np.array(sides), need, np.array(near))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], names=["a", "b"]) if found else None

    for batch in batches:
        kind = batch.schema.field("id").type
        groups = zip(batch.column("cluster").to_pylist(), batch.column("task").to_pylist(), strict=True)
        for at, *row in zip(groups, *(batch.column(c).to_pylist() for c in ("id", "set", "side", "near")), strict=True):
            if at != key:
                if (out := done()) is not None:
                    yield out
                key, rows = at, []
            rows.append(row)
    if (out := done()) is not None:
        yield out


def _spread(members: Column, block: int) -> Column:
    """Number of copies of what all sets of a cluster meet: one for each ``block`` of them, so that none is a hot key."""
    return F.ceil(members / F.lit(block)).cast("int")


def _pivot_links(sets: DataFrame, cells: DataFrame, need: int, block: int, kind: str) -> DataFrame:
    """(a, b): the members of large clusters that are linked with their cluster's pivot, and the pivot.

    The pivot is a fixed member of the size class with the most sets; its
    copies, one for each ``block`` members, spread a cluster over tasks.
    """
    best = cells.groupBy(F.col("cluster").alias("of")).agg(F.max_by("bin", F.struct("n", "bin")).alias("pivot_bin"), F.max_by("least", F.struct("n", "bin")).alias("pivot"), _spread(F.sum("n"), block).alias("copies"))
    pivots = sets.select("id", F.col("set").alias("pivot_set")).join(best, F.col("id") == F.col("pivot")).drop("id")
    spread = pivots.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("of", "pivot", "pivot_bin", "pivot_set", "copy")
    members = sets.where(F.col("members") > block).select("id", "cluster", "bin", "set", F.pmod(F.xxhash64("id"), _spread(F.col("members"), block)).cast("int").alias("mine"))
    pairs = members.join(spread, (F.col("cluster") == F.col("of")) & (F.col("mine") == F.col("copy")) & (F.col("id") != F.col("pivot")))
    pairs = pairs.where(F.abs(F.col("bin") - F.col("pivot_bin")) <= 1).select("id", "pivot", "set", "pivot_set")
    return pairs.mapInArrow(lambda it: _near_pivot(it, need), f"a {kind}, b {kind}")


def _dealt(sets: DataFrame, block: int) -> DataFrame:
    """id, set, near, side and (cluster, task): each set once for every block that it has to meet.

    A cell is a size class of a cluster, apart for sets that are near the
    pivot; it has a block for each ``block`` sets. Blocks of two cells meet if
    the classes are neighbours and not both are near the pivot.
    """
    cells = sets.groupBy("cluster", "bin", "near").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), _spread(F.max("members"), block).alias("copies")).withColumn("cell", F.col("bin") * 2 + F.col("near").cast("int"))
    other = cells.select(F.col("cluster").alias("_c"), F.col("bin").alias("_b"), F.col("near").alias("_n"), F.struct("cell", "blocks").alias("to"))
    meet = cells.join(other, (F.col("cluster") == F.col("_c")) & (F.abs(F.col("bin") - F.col("_b")) <= 1) & ~(F.col("near") & F.col("_n")))
    plan = meet.groupBy(F.col("cluster").alias("_c"), F.col("bin").alias("_b"), F.col("near").alias("_n"), "cell", "blocks", "copies").agg(F.collect_list("to").alias("to"))
    plan = plan.withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mine = F.pmod(F.xxhash64(F.lit("copy"), F.col("id")), _spread(F.col("members"), block)).cast("int")
    at = sets.withColumn("mine", mine).join(plan, (F.col("cluster") == F.col("_c")) & (F.col("bin") == F.col("_b")) & (F.col("near") == F.col("_n")) & (F.col("mine") == F.col("_m")))
    at = at.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("to", F.explode("to")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)))
    mine, its = F.struct("cell", "own"), F.struct("to.cell", F.col("block").alias("own"))
    side = F.when(mine == its, 2).when(mine < its, 0).otherwise(1)
    first, second = F.when(mine < its, mine).otherwise(its), F.when(mine < its, its).otherwise(mine)
    task = F.concat_ws(",", first["cell"], first["own"], second["cell"], second["own"])
    return at.select("id", "cluster", "set", "near", task.alias("task"), side.alias("side"))


def near_duplicates(docs: DataFrame, need: int = 85, k: int = SHINGLE, functions: int = FUNCTIONS, width: int = BAND, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id).

    A link joins texts with 100 * intersection >= need * union of their shingle
    sets. A null or empty text has no shingles and no links; rows without
    doc_id take no part and are kept (component null); rows that share a doc_id are one
    document with the links of each of them and come out one by one; extra
    columns are ignored; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    with shuffles_once(spark):
        signed = cut(
            docs.select("doc_id", "text").mapInArrow(lambda it: _signed(it, k, functions, width), f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")
        )
        some = signed.where("n_shingles > 0 and doc_id is not null")
        # texts with equal sets become one representative, the least doc_id
        reps = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        reps = cut(reps)
        banded = reps.select("rep", F.explode("bands").alias("band"))
        stars = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
        clusters = cut(components(banded.join(stars, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))))

        sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
        members = reps.select("rep", "s1", "s2", "n_shingles").join(clusters, F.col("rep") == F.col("id")).join(sizes, "component")
        bin_ = F.when(F.col("members") > block, F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(log(100 / need) + 1e-9)).cast("int")).otherwise(0)
        members = cut(members.select("rep", F.col("component").alias("cluster"), "s1", "s2", "members", bin_.alias("bin")))
        wanted = spark.sparkContext.broadcast(bit_map(F.xxhash64("rep"), members, members.count()))
        sets = docs.select("doc_id", F.xxhash64("doc_id"), "text").where("doc_id is not null").mapInArrow(lambda it: _sets(it, k, wanted.value), f"id {kind}, t1 bigint, t2 bigint, set binary")
        sets = sets.join(members, (F.col("id") == F.col("rep")) & (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2"))).select("id", "cluster", "bin", "members", "set")
        cells = members.where(F.col("members") > block).groupBy("cluster", "bin").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("least"))
        first = None
        if cells.limit(1).count():
            sets = cut(sets)
            first = cut(_pivot_links(sets, cells, need, block, kind))
            near = first.select(F.col("a").alias("_near")).unionByName(first.select(F.col("b").alias("_near"))).distinct()
            sets = sets.join(near, F.col("id") == F.col("_near"), "left").withColumn("near", F.col("_near").isNotNull())
        else:
            sets = sets.withColumn("near", F.lit(False))
        dealt = _dealt(sets, block).repartition("cluster", "task").sortWithinPartitions("cluster", "task", "id")
        links = dealt.mapInArrow(lambda it: _linked(it, need), f"a {kind}, b {kind}")
        if first is not None:
            links = links.unionByName(first)

        # two sets of one doc_id (repeated ids) hold together through that id
        shared = some.join(reps.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"]).select("doc_id", "rep")
        several = shared.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
        comps = cut(components(links.unionByName(several.select("a", F.explode("reps").alias("b")))))
    of_rep = shared.join(comps, F.col("rep") == F.col("id"), "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("class"))
    per = of_rep.groupBy("_d").agg(F.min("class").alias("class"))
    out = signed.select("doc_id", "n_shingles").join(per, F.col("doc_id") == F.col("_d"), "left")
    component = F.coalesce("class", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose document stays; of rows that share a doc_id one, the least in all columns; rows without doc_id stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), **how).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi")
    one = stay.groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    return one.unionByName(docs.where("doc_id is null"))
