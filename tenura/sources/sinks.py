"""Writing tables and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str) -> None:
    """Write a table; a path ending in .csv gets header CSV, any other Parquet."""
    writer = df.write.mode("overwrite")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_bucketed(
    df: DataFrame, name: str, path: str, key: str, order: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Store a table by ``key`` under a catalog name, and return it as the catalog reads it.

    Rows are shuffled once, here: a bucket is one file, sorted by key and ``order``. Windows,
    aggregates and joins by the key over tables with equally many buckets need no exchange. By
    default there are as many buckets as a shuffle has partitions. A key that may hold a large
    share of the rows should not be stored this way, as its rows share one file. ``path`` must be in
    a folder all executors share; an existing table of that name is replaced.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name))
    return spark.table(name)


def write_document(df: DataFrame, path: str) -> None:
    """Write a nested report as JSON lines, keeping NULL fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
