"""Sharding by jump consistent hashing, on built-in functions only.

The generator of the published algorithm (Lamping & Veach 2014) multiplies
64-bit words modulo 2**64. Spark's ANSI arithmetic raises on overflow, so the
state is held as an unsigned number in a decimal, where the product fits
(below 1.85e19 * 2.87e18 < 1e38).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
#: A walk makes about ln(shards) jumps; more than this have a chance below 1e-40 for any count up to 2**31.
MAX_JUMPS = 160
#: Rows that share one window when slots are numbered.
ROWS_PER_BLOCK = 20_000


def jump_hash(key: str, n_shards: int) -> Column:
    """struct(shard, grown): the place of a bigint key among ``n_shards`` and among one more.

    One walk gives both: the jumps of a key do not depend on the shard count,
    which only tells where the walk ends. A null key gives nulls.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    n = int(n_shards)
    return F.expr(f"""
        aggregate(
          sequence(1, {min(n + 1, MAX_JUMPS)}),
          named_struct('k', cast(case when {key} < 0 then cast({key} as decimal(20,0)) + 18446744073709551616BD else {key} end as decimal(38,0)),
                       'j', 0L, 'shard', 0L, 'grown', 0L),
          (a, i) -> case when a.j > {n} then a else
            transform(array(cast((a.k * cast({MULTIPLIER} as decimal(19,0)) + 1BD) % 18446744073709551616BD as decimal(38,0))),
              k -> named_struct('k', k,
                'j', cast(floor((a.j + 1) * (2147483648D / cast((k div 8589934592BD) + 1 as double))) as bigint),
                'shard', case when a.j < {n} then a.j else a.shard end,
                'grown', a.j))[0] end,
          a -> named_struct('shard', case when {key} is not null then cast(a.shard as int) end,
                            'grown', case when {key} is not null then cast(a.grown as int) end))
    """)


def slots(df: DataFrame, shard: str, order: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... without gaps within each shard.

    A window over a whole shard would put it into one task. Rows go to blocks
    by a hash of their order key; only the blocks are numbered by windows, and
    each block's start is a running sum over the block counts, a table of some
    thousandth of the rows.
    """
    from pyspark.sql import Window as W

    blocks = F.lit(max(1, -(-df.count() // rows_per_block)))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(F.lit("slot"), F.col(order)), blocks))
    counts = dealt.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    starts = counts.select(shard, "_block", (F.sum("_n").over(W.partitionBy(shard).orderBy("_block")) - F.col("_n")).alias("_start"))
    numbered = dealt.withColumn("_at", F.row_number().over(W.partitionBy(shard, "_block").orderBy(order)) - 1)
    keys = [numbered[c].eqNullSafe(starts[c]) for c in (shard, "_block")]
    return numbered.join(starts, keys).select(*[numbered[c] for c in df.columns], (F.col("_start") + F.col("_at")).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``key``: doc_id and the shard count decide. ``grown_shard`` is
    the place with one more shard, which is either ``shard`` or the new one.
    A null text has no bytes (size 1, crc32 0); a row without doc_id goes to
    shard 0 in both; repeated rows share a shard and get a slot each; other columns are ignored.
    """
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash("doc_id", n_shards).alias("_at"),
    ).select("doc_id", "size", "text_crc32", "law", F.coalesce("_at.shard", F.lit(0)).alias("shard"), F.coalesce("_at.grown", F.lit(0)).alias("grown_shard"))
    return slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
