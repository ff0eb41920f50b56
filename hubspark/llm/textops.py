"""Column builders shared by the JVM-side text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as runs of anything but ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: Words as runs of ASCII letters and digits and all non-ASCII characters (after lower-casing).
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    The optimizer may inline a projected column into each place that names it,
    inside a lambda even once per element; a lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z only. ``lower`` is faster but also folds non-ASCII letters, so it serves ASCII texts alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, pattern: str) -> Column:
    """All words of the whole text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def hashes(items: Column) -> Column:
    """64-bit hash of each element."""
    return F.transform(items, lambda x: F.xxhash64(x))


def grams(items: Column, k: int) -> Column:
    """Hash of each run of ``k`` elements, in order; empty when there are fewer."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(items) >= k, F.transform(F.sequence(F.lit(1), F.size(items) - (k - 1)), lambda i: F.xxhash64(F.slice(items, i, k)))).otherwise(none)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without: its one machine has a temporary folder that all its threads share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_once(spark: SparkSession) -> Iterator[None]:
    """What a step inside shuffles leaves the disk at the step's end; for steps that run once and are checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
