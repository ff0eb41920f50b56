"""Labelled samples for the models trained on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % n


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> pa.Table:
    """text and label of at most ``bound`` labelled documents outside the held-out fold, in a fixed order.

    The first ids in the order of a hash are taken, so that the sample is even
    over the table and the same for the same ids. Rows without id or label do
    not count; an id with several labels takes the greatest; of repeated rows
    of an id one, the least text, is used. The joined side has ``bound`` rows at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("_d"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_d"))
    rows = rows.groupBy("_d", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("_d", "text", "label").toArrow().sort_by("_d")
