"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Vectors become integers; the fit runs over each distinct vector once. Every task reduces its
centred rows to one triangular factor, factors are reduced together in groups until one of the size
columns by columns is left, and the squared singular values of that factor over n are the
eigenvalues of the covariance, which itself is never formed. ``bidiagonal`` finds values and
directions on the driver from that one factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm import bidiagonal
from tenura.sources.scratch import materialize

# Integer steps per unit.
STEPS = 256
# Factors that one task reduces together.
FAN_IN = 32
# Rows reduced at once.
BLOCK = 4096


def to_steps(vector: Column, steps: int = STEPS) -> Column:
    """The vector as integers floor(steps * entry), or null if it or an entry isn't finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    entries = F.transform(vector, lambda x: x.cast("double"))
    whole = F.transform(entries, lambda x: F.floor(x * float(steps)).cast("long"))
    return F.when(F.forall(entries, finite), whole)


def _common_length(rows: DataFrame) -> int:
    """The length most vectors have; the larger of equals; 0 without rows."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _square(r: np.ndarray, d: int) -> np.ndarray:
    """A triangular factor of fewer rows filled up with zeros."""
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def triangular_factor(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the rows of ``fit`` (x array<long>) less ``mean``, by blocks and then by groups."""
    d = len(mean)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            rows = _matrix(batch.column(0))
            for at in range(0, len(rows), BLOCK):
                block = rows[at:at + BLOCK].astype(float) - mean
                r = np.linalg.qr(np.vstack([r, block]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([_square(r, d).ravel().tolist()], pa.list_(pa.float64()))],
                names=["part", "r"])

    def reduce_factors(group: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d))
        for other in group.sort_values("part")["r"]:
            r = np.linalg.qr(np.vstack([r, np.asarray(other).reshape(d, d)]), mode="r")
        return pd.DataFrame({"part": [group["part"].min() // FAN_IN],
                             "r": [_square(r, d).ravel()]})

    schema = "part long, r array<double>"
    factors = materialize(fit.select("x").mapInArrow(reduce_rows, schema), "factors")
    left = factors.agg(F.coalesce(F.max("part") + 1, F.lit(0))).first()[0]
    while left > 1:
        grouped = factors.groupBy(F.floor(F.col("part") / FAN_IN).alias("group"))
        factors = materialize(grouped.applyInPandas(reduce_factors, schema), "factors")
        left = -(-left // FAN_IN)
    # One row of the size of the model.
    rows = factors.collect()
    return np.array(rows[0]["r"]).reshape(d, d) if rows else np.zeros((d, d))


def fit_directions(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, unit eigenvectors (rows) and trace of the covariance r' r / n.

    Directions without variance beyond rounding are left out, so fewer than ``k`` may come back.
    """
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.zeros(0), np.zeros((0, len(r))), 0.0
    diagonal, above, reflections = bidiagonal.bidiagonalise(r / scale)
    squares = bidiagonal.dqds_values(diagonal, above)
    rounding = 64 * len(r) * bidiagonal.EPS
    squares = squares[:k][squares[:k] > squares[0] * rounding ** 2]
    found = bidiagonal.leading_vectors(diagonal, above, squares)
    vectors = np.array([bidiagonal.back(z, reflections) for z in found]).reshape(-1, len(r))
    trace = float(np.square(r / scale).sum())
    unit = scale * scale / n
    return squares * unit, vectors, trace * unit


def identity_error(fit: DataFrame, mean: np.ndarray, projection: np.ndarray, n: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit rows, less identity."""
    k = len(projection)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                white = (_matrix(batch.column(0)).astype(float) - mean) @ projection.T
                total[:k] += white.T @ white
                total[k] += white.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())],
            names=["place", "total"])

    sums = (fit.select("x").mapInArrow(moments, "place int, total double")
            .groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect())
    total = np.array([r["total"] for r in sums]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id",
           vector_col: str = "embedding", steps: int = STEPS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row per input row and component (from 1, by falling eigenvalue). Rows whose vector is null
    or holds null or non-finite entries are left out, and so are rows whose vector is not of the
    length that most have (the longer of equals). Components without variance are left out, so
    equal vectors only, or no rows, give an empty result. ``deviation`` is exact; null where it
    doesn't fit into a long. Null and repeated ids are rows like any other.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("id"),
                           to_steps(F.col(vector_col), steps).alias("x"))
            .where(F.col("x").isNotNull()))
    rows = materialize(rows, "steps")
    d = _common_length(rows)
    rows = rows.where(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "fit")
    n = fit.count()
    # As many sums as columns.
    sums = [r["s"] for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum("v").alias("s")).orderBy("i").collect()]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    r = triangular_factor(fit, mean) if d else np.zeros((0, 0))
    values, directions, trace = fit_directions(r, max(n, 1), components)
    id_type = rows.schema["id"].dataType.simpleString()
    if not len(values):
        return spark.createDataFrame(
            [], f"{id_col} {id_type}, component int, n long, deviation long, whitened double, "
                "explained double, identity_error double")
    projection = directions / np.sqrt(values)[:, None]
    error = identity_error(fit, mean, projection, n)

    @F.pandas_udf("array<double>")
    def whitened(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(x.to_numpy()).astype(float) - mean) @ projection.T))

    totals = F.array(*[F.lit(s).cast("long") for s in sums])
    away = F.zip_with("x", totals, lambda a, s: F.try_subtract(F.try_multiply(a, F.lit(n)), s))
    deviation = F.aggregate(away, F.lit(0).cast("long"),
                            lambda total, v: F.try_add(total, F.try_multiply(v, v)))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    return (rows.select("id", deviation.alias("deviation"), whitened("x").alias("w"))
            .select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("i") + 1).alias("component"),
                    F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("i")).alias("explained"),
                    F.lit(error).alias("identity_error")))
