"""A corpus pipeline of five operators, each reading what the one before wrote.

Null and empty texts fail the quality rules' base part and go; rows without
doc_id take no part in near-dedup and stay; repeated rows of a doc_id leave one;
extra columns go through to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from hubspark.llm import decontam, minhash, quality_rules, sentencepiece_scan, toxicity
from hubspark.llm.textops import checkpoint_folder, read
from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or fit a learned rule go."""
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five-word shingles, similarity 0.8."""
    # 26 bands of 5 values: a pair of similarity 0.8 shares none with a chance of 3e-5
    return minhash.one_of_each(docs, need=80, functions=65, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of what is left."""
    return sentencepiece_scan.encode(docs, sentencepiece_scan.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: The learned stages and the segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
