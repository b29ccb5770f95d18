"""Scoring a stream of feature rows with the batch scoring plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tenura.plans.training import score
from tenura.sources.artifacts import Artifact


def read_rows(spark: SparkSession, folder: str, declared: T.StructType) -> DataFrame:
    """Parquet files of scoring rows as they arrive in a folder."""
    return spark.readStream.schema(declared).parquet(folder)


def score_stream(
    rows: DataFrame, artifact: Artifact, answers: str, rejected: str, checkpoints: str
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start writing answers and rejected rows to Parquet folders.

    Scoring keeps no state between rows, so every batch of files is scored independently and the
    sinks' commit logs make each row appear once.
    """

    def start(df: DataFrame, folder: str, name: str) -> StreamingQuery:
        return (df.writeStream.format("parquet").outputMode("append")
                .option("path", folder)
                .option("checkpointLocation", f"{checkpoints}/{name}")
                .trigger(availableNow=True)
                .start())

    good, bad = score(rows, artifact)
    return start(good, answers, "answers"), start(bad, rejected, "rejected")
