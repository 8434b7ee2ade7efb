"""Where repaired texts go. Inputs are never written over: a new version is a new folder, and the first backup of a text stays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str) -> None:
    """df as a new folder of Parquet; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_backup(spark: SparkSession, originals: DataFrame, path: str, key: str = "rel") -> int:
    """Adds the originals whose key has no backup yet; how many that were. What was backed up first is never replaced."""
    rows = originals.dropDuplicates([key])
    try:
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException:
        pass
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()


def apply_repairs(spark: SparkSession, originals: DataFrame, repaired: DataFrame, version: str, backup: str, key: str = "rel") -> int:
    """Backs the changed texts up and writes the whole collection, changed texts in their new form, as a new version. repaired:
    key, text and would_write or changed. Returns the number of changed texts."""
    flag = "would_write" if "would_write" in repaired.columns else "changed"
    new = repaired.where(flag).select(key, F.col("text").alias("__new"))
    joined = originals.join(new, key, "left")
    changed = joined.where("__new is not null")
    write_backup(spark, changed.select(key, "text"), backup, key)
    write_version(joined.withColumn("text", F.coalesce("__new", "text")).drop("__new"), version)
    return changed.count()


def write_preview(repaired: DataFrame, path: str) -> None:
    """Changed texts alone, under their whole rel, for reading before anything is applied."""
    write_version(repaired.where("changed"), path)


def queue_rows(ladder: DataFrame) -> DataFrame:
    """rel, status (reocr, nopdf, done), rates to two places and why of what the ladder came to."""
    return ladder.select("rel", "status", F.round("sp0", 2).alias("sp0"), F.round("sp1", 2).alias("sp1"), "why")


def write_queue(ladder: DataFrame, path: str) -> None:
    """The queue of a new recognition as JSON lines."""
    queue_rows(ladder).write.mode("errorifexists").json(path)
