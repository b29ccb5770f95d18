"""Saving and loading a fitted pipeline with its identity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("decision_threshold", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Artifact:
    """A fitted pipeline, its input columns, its vector's feature names and its identity."""

    pipeline: PipelineModel
    model_name: str
    model_version: str
    decision_threshold: float
    features: Sequence[str]
    feature_names: Sequence[str]

    def metadata(self, spark: SparkSession) -> DataFrame:
        row = (self.model_name, self.model_version, float(self.decision_threshold),
               list(self.features), list(self.feature_names))
        return spark.createDataFrame([row], METADATA)


def save(artifact: Artifact, spark: SparkSession, path: str) -> None:
    artifact.pipeline.write().overwrite().save(f"{path}/pipeline")
    artifact.metadata(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Artifact:
    row = spark.read.schema(METADATA).parquet(f"{path}/metadata").first()
    return Artifact(PipelineModel.load(f"{path}/pipeline"), **row.asDict())
