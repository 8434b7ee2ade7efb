"""What every operator needs from the session: a shared folder for cut lineage, size-checked broadcasts, rows counted once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows up to which a narrow frame (a key and a few numbers, under 200 bytes a row) is broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Where none is set, a temporary one in local mode, whose
    only machine is this one; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliomend-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_RELEASED_AT_EXIT: set[str] = set()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliomend-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: later stages read the files, so a lost executor costs nothing. The
    files go with the application, or earlier by release."""
    spark = df.sparkSession
    folder = _tables(spark)
    if folder not in _RELEASED_AT_EXIT:
        _RELEASED_AT_EXIT.add(folder)
        atexit.register(_quietly_released, spark)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all tables that this application stored. What was built on them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _quietly_released(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped has no file system any more
        release(spark)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint only if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def one_row_per(df: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each value of key, without moving the wide columns: repeated keys are found on (key, place in the files)
    alone and only those are joined back, by broadcast if they are few. Rows with a null key can't be told apart and all stay.
    df must come straight from files; any other frame falls back to a shuffle of its rows."""
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
    repeated = stored(
        placed.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.count("*").alias("__n"), F.min(F.struct("__path", "__row")).alias("__keep"))
        .where("__n > 1")
        .select("__key", "__keep")
    )
    kept = small_side(repeated, repeated.count(), limit)
    return (
        placed.join(kept, placed[key] == kept["__key"], "left")
        .where(F.col("__keep").isNull() | (F.struct("__path", "__row") == F.col("__keep")))
        .select(*df.columns)
    )


def filled(run: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run without the empty frames it gives, whose columns have no types to go by."""
    return lambda batches: (frame for frame in run(batches) if len(frame))


def map_columns(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, Sequence]]], schema: str) -> DataFrame:
    """df.mapInArrow with batches as lists by column name, in and out, so that integers beside nulls stay integers."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for columns in run(lists):
            if len(columns[out.names[0]]):
                yield pa.record_batch([pa.array(columns[f.name], f.type, from_pandas=True) for f in out], schema=out)

    return df.mapInArrow(arrow, schema)


def map_rows(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterable[list[tuple]]], schema: str) -> DataFrame:
    """map_columns for a run that gives lists of rows."""
    names = [f.name for f in StructType.fromDDL(schema)]
    return map_columns(df, lambda batches: (dict(zip(names, zip(*rows))) for rows in run(batches) if rows), schema)
