"""A forest over the ``features`` vector as a pipeline stage.

Trees stand in arrays one after another, some twelve bytes a node, and rows pass by them in Arrow
batches. Objects for every node, as Spark's own class keeps them, would fill the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.sources.scratch import release

# Rows that go through the trees together.
ROWS = 1 << 12
# Nodes in one part of a stored model, and of one that is loaded.
STORED = 1 << 16
_COLUMNS = "at long, feature int, left int, number double"


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return values.astype(np.int16 if values.max(initial=0) < 1 << 15 else np.int32)


class Compressed:
    """Arrays as fields, which travel to tasks compressed."""

    def __getstate__(self) -> dict[str, tuple[str, int, bytes]]:
        return {name: (v.dtype.str, v.nbytes, pa.compress(v.tobytes(), codec="zstd", asbytes=True))
                for name, v in self.__dict__.items()}

    def __setstate__(self, state: dict[str, tuple[str, int, bytes]]) -> None:
        self.__dict__.update({
            name: np.frombuffer(pa.decompress(v, decompressed_size=size, codec="zstd",
                                              asbytes=True), kind)
            for name, (kind, size, v) in state.items()})


@dataclass(frozen=True)
class Nodes(Compressed):
    """The nodes of all trees. Tree i starts at ``starts[i]``; ``left`` counts from there and the
    right child follows the left one. Values above ``number`` go right; a leaf has feature -1 and
    its rate as ``number``."""

    starts: np.ndarray
    feature: np.ndarray
    left: np.ndarray
    number: np.ndarray

    def rates(self, x: np.ndarray) -> np.ndarray:
        """The mean value of the leaves that each row ends in."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for start in self.starts:
            node = np.full(len(x), start)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature, 0)] > self.number[node]
                node = np.where(inner, start + self.left[node] + right, node)
            total += self.number[node]
        return total / max(len(self.starts), 1)


class ForestModel(Model, HasFeaturesCol, HasProbabilityCol, HasPredictionCol, MLReadable, MLWritable):
    """The mean rate of class 1 over the trees, as ``probability`` and ``prediction``."""

    @keyword_only
    def __init__(self, *, nodes: Nodes | None = None, importances: Sequence[float] = ()):
        super().__init__()
        self._setDefault(featuresCol="features", probabilityCol="probability",
                         predictionCol="prediction")
        self.nodes, self.importances = nodes, list(importances)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as Spark's tree models call it
        return Vectors.dense(self.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        nodes, width = self.nodes, len(self.importances)

        def rate(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            parts = [nodes.rates(rows[i:i + ROWS]) for i in range(0, len(rows), ROWS)]
            return pa.array(np.concatenate(parts or [np.zeros(0)]), pa.float64())

        p = F.arrow_udf(rate, "double")(vector_to_array(F.col(self.getFeaturesCol())))
        found = dataset.withColumn(self.getPredictionCol(), p)
        p = F.col(self.getPredictionCol())
        return found.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p))) \
            .withColumn(self.getPredictionCol(), (p > 0.5).cast("double"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        model, nodes = self.model, self.model.nodes
        DefaultParamsWriter.saveMetadata(
            model, path, self.sparkSession,
            extraMetadata={"starts": nodes.starts.tolist(), "importances": model.importances})
        for first in range(0, max(len(nodes.feature), 1), STORED):
            part = slice(first, first + STORED)
            table = pa.table([pa.array(np.arange(first, first + len(nodes.feature[part]))),
                              pa.array(nodes.feature[part].astype(np.int32)),
                              pa.array(nodes.left[part].astype(np.int32)),
                              pa.array(nodes.number[part])],
                             names=["at", "feature", "left", "number"])
            self.sparkSession.createDataFrame(table, _COLUMNS).write.mode("append").parquet(
                f"{path}/nodes")
            release(self.sparkSession)


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stored = self.sparkSession.read.schema(_COLUMNS).parquet(f"{path}/nodes")
        count = stored.selectExpr("coalesce(max(at) + 1, 0) AS n").first()["n"]
        own = {"feature": np.empty(count, np.int32), "left": np.empty(count, np.int32),
               "number": np.empty(count)}
        for first in range(0, count, STORED):
            part = stored.where(F.col("at").between(first, first + STORED - 1)).toArrow()
            at = part.column("at").to_numpy()
            for name, values in own.items():
                values[at] = part.column(name).to_numpy()
            del part, at
            release(self.sparkSession)
        model = ForestModel(
            nodes=Nodes(np.array(metadata["starts"], np.int64), narrow(own["feature"]),
                        narrow(own["left"]), own["number"]),
            importances=metadata["importances"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
