"""Text trees, head lists and dictionaries as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomend.runtime import map_rows


def decoded(content: Column, fold_newlines: bool = True) -> Column:
    """Bytes as text: invalid UTF-8 becomes U+FFFD, and \\r\\n becomes \\n unless fold_newlines is false."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.replace(text, F.lit("\r\n"), F.lit("\n")) if fold_newlines else text


def text_tree(spark: SparkSession, root: str, fold_newlines: bool = True, skip_underscored: bool = True) -> DataFrame:
    """rel and text of the .txt files (in any case) under root, folders included. Files and folders whose names begin with _
    are left out. With skip_underscored false they aren't, nor are names that begin with ., which no listing of Spark's shows:
    the file system's own listing is taken then, whose names pass the driver."""
    base = _absolute(spark, root).rstrip("/") + "/"
    if skip_underscored:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(root)
    else:
        names = [p for p in _listed(spark, root) if p.lower().endswith(".txt")]
        files = _read(spark, names)
    rel = F.replace(F.col("path"), F.lit(base), F.lit(""))
    out = files.select(rel.alias("rel"), decoded(F.col("content"), fold_newlines).alias("text"))
    return out.where(~F.exists(F.split("rel", "/"), lambda x: F.startswith(x, F.lit("_")))) if skip_underscored else out


def _listed(spark: SparkSession, root: str) -> list[str]:
    """All files under a folder, by the file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return sorted(out)


def _read(spark: SparkSession, names: list[str]) -> DataFrame:
    """path and content of files by their names, whatever these begin with: Spark's own readers leave out some even if asked."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for name in batch["path"]:
                system, place = pa_fs.FileSystem.from_uri(name)
                with system.open_input_stream(place) as stream:
                    rows.append((name, stream.read()))
            yield rows

    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism)))
    return map_rows(paths, run, "path string, content binary")


def listed_files(spark: SparkSession, paths: list[str], fold_newlines: bool = False) -> DataFrame:
    """path and text of files given by name, such as those that begin with _, which no listing of Spark's shows."""
    return _read(spark, [_absolute(spark, p) for p in paths]).select("path", decoded(F.col("content"), fold_newlines).alias("text"))


def _absolute(spark: SparkSession, root: str) -> str:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


def running_heads(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file of running heads, without spaces around them and without blank ones. Such a list is one book's."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """w, in lower case, of a word list with a word in each line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()
