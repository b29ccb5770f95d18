"""Reading and registering the base tables and stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura import schema


def read_csv(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """Header CSV under a declared schema; columns are matched by header name.

    A value that does not parse fails the job, as loading it into a typed table would.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in declared.fields])
    header = spark.read.option("header", True).csv(path)
    missing = set(raw.fieldNames()) - set(header.columns)
    if missing:
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    return conform(header, declared)


def read_table(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    return conform(spark.read.parquet(path), declared)


def conform(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Project and cast to a declared schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    reader = read_csv if path.endswith(".csv") else read_table
    return reader(spark, path, schema.CUSTOMERS)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    reader = read_csv if path.endswith(".csv") else read_table
    return reader(spark, path, schema.USAGE)


def register(customers: DataFrame, usage: DataFrame) -> None:
    """Make the base tables available to SQL under their declared types."""
    conform(customers, schema.CUSTOMERS).createOrReplaceTempView("customers")
    conform(usage, schema.USAGE).createOrReplaceTempView("customer_monthly_usage")


def register_features(features: DataFrame, name: str = "churn_features") -> DataFrame:
    """Name the feature query as a view and return the view."""
    features.createOrReplaceTempView(name)
    return features.sparkSession.table(name)


def read_report(spark: SparkSession, path: str, declared: T.StructType | None = None) -> DataFrame:
    """Read back a report written by ``sinks``; the format is the path's last suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read
    if kind == "csv":
        return read_csv(spark, path, declared) if declared else reader.csv(
            path, header=True, inferSchema=True)
    if declared is not None:
        reader = reader.schema(declared)
    if kind not in ("json", "parquet"):
        raise ValueError(f"unknown report format in {path}")
    return reader.format(kind).load(path)
