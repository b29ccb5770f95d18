"""Intermediate tables written to the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tenura-")
    return _LOCAL_DIRS[app]


def _run_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tenura-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; frames read from it can't be used any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage, survives lost executors, and lets every later pass read only its columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    stored.scratch_path = path
    return stored


def drop(stored: DataFrame) -> None:
    """Delete a table that ``materialize`` returned, once what was made of it is stored itself."""
    spark = stored.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver give up what dropped frames leave behind: plans, results and broadcasts.

    Hundreds of short passes make little that stays, but let the heap grow to its limit before the
    JVM collects all of it and returns the room.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
