"""Result bundles: Parquet tables with metadata, a manifest, checksums and resumable grids."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def make_meta(dataset: str, generated_by: str, network_source: str, **more) -> dict:
    if not isinstance(network_source, str) or not network_source.strip():
        raise ValueError("network_source must name where the graph comes from")
    return {"dataset": dataset, "generated_by": generated_by, "generated_on": datetime.now(UTC).strftime("%Y-%m-%d"), "network_source": network_source, **more}


def save(df: DataFrame, root: str, meta: dict) -> None:
    """Writes the rows and the metadata beside them, both by Spark, so any store it knows will do."""
    where = f"{root}/{meta['dataset']}"
    df.write.mode("overwrite").parquet(f"{where}/results")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/meta")


def load(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict] | None:
    """(rows, metadata), or None with a warning where there is no such dataset."""
    import warnings

    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.text(f"{root}/{name}/meta").first()
        return spark.read.parquet(f"{root}/{name}/results"), json.loads(meta["value"])
    except AnalysisException:
        warnings.warn(f"no dataset {name!r} in {root}", stacklevel=2)
        return None


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, generated_on, network_source) of the bundles under a folder."""
    lines = spark.read.text(f"{root}/*/meta").where("value <> ''")
    return lines.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("dataset", "generated_on", "network_source")])


MANIFEST = "dataset string, generated_on string, generated_by string, first_release string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) from lines "sha256  file"."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where("value <> ''").select(parts[1].alias("file"), parts[0].alias("sha256"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files themselves."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def updated_manifest(old: DataFrame, new: DataFrame, release: str) -> DataFrame:
    """Rows of ``new``; a dataset keeps the release it first came with."""
    first = old.select("dataset", F.col("first_release").alias("_first"))
    return new.join(first, "dataset", "left").select("dataset", "generated_on", "generated_by", F.coalesce("_first", F.lit(release)).alias("first_release"))


def provenance(meta: DataFrame, manifest: DataFrame, sums: DataFrame, suffix: str = "") -> DataFrame:
    """dataset, generated_by, generated_on, first_release, sha256 of each bundle; what is not known is null."""
    m = manifest.select("dataset", F.col("generated_on").alias("_on"), F.col("generated_by").alias("_by"), "first_release")
    files = sums.select(F.col("file").alias("_file"), "sha256")
    out = meta.join(m, "dataset", "left").join(files, F.concat("dataset", F.lit(suffix)) == F.col("_file"), "left")
    return out.select("dataset", F.coalesce("generated_by", "_by").alias("generated_by"), F.coalesce("generated_on", "_on").alias("generated_on"), "first_release", "sha256")


def undone(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a grid that have no result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def replace_method(results: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Results with one method's rows exchanged."""
    return results.where(F.col("method") != method).unionByName(new, allowMissingColumns=True)
