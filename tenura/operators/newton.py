"""Logistic regressions of all fit sets at once, by Newton steps.

One pass per step: every task adds up the loss, the slope and the curvature of each fit set over
its rows, and Spark adds the tasks' sums. What reaches the driver is one square matrix per fit set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.operators.encoded import Encoded, dense, design, read, summed


def _terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, slope and curvature as one flat array."""
    z = x @ beta
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    loss = float(w @ (np.logaddexp(0, z) - y * z))
    slope = x.T @ (w * (p - y))
    curve = (x * (w * p * (1 - p))[:, None]).T @ x
    return np.concatenate(([loss], slope, curve.ravel()))


def fit(rows: Encoded, weights: dict[str, tuple[float, float]], penalty: float = 1.0,
        max_iter: int = 2000, tol: float = 1e-10) -> dict[str, np.ndarray]:
    """Coefficients per fit set, the intercept last.

    Minimises the weighted loss plus half the ``penalty`` times the squared coefficients without
    the intercept. A step that raises the loss is halved. Ends when no set's step moves its
    coefficients by more than ``tol``, or after ``max_iter`` passes.
    """
    names, fills = rows.names, rows.sets
    widths = {s: len(rows.sets[s].preprocessing.feature_names) + 1 for s in names}
    sizes = {s: 1 + k + k * k for s, k in widths.items()}
    beta = {s: np.zeros(widths[s]) for s in names}
    before = {s: (np.inf, None) for s in names}  # loss and coefficients of the last good step
    open_sets = [s for s in names if rows.sets[s].preprocessing.rows]
    for _ in range(max_iter):
        if not open_sets:
            break
        starts = dict(zip(open_sets, np.cumsum([0] + [sizes[s] for s in open_sets])))
        now = {s: beta[s] for s in open_sets}

        size = sum(sizes[s] for s in open_sets)

        def partial(batch, _, now=now, starts=starts, open_sets=tuple(open_sets), size=size):
            total = np.zeros((size, 1))
            for s in open_sets:
                mine = fills[s].member[batch.part]
                if mine.any():
                    x, y = design(batch, fills[s])[mine], batch.label[mine]
                    low, high = weights[s]
                    total[starts[s]:starts[s] + sizes[s], 0] = _terms(
                        x, y, np.where(y == 1, high, low), now[s])
            return np.arange(size), total

        total = dense(*summed(rows, rows.rows, partial, 1), 0, size)[:, 0]
        done = []
        for s in open_sets:
            k = widths[s]
            flat = total[starts[s]:starts[s] + sizes[s]]
            ridge = np.full(k, penalty)
            ridge[-1] = 0.0
            loss = flat[0] + 0.5 * float(ridge @ np.square(beta[s]))
            good, kept = before[s]
            if loss > good + 1e-12 * abs(good):
                beta[s] = (beta[s] + kept) / 2
                if np.abs(beta[s] - kept).max() <= tol:
                    beta[s] = kept
                    done.append(s)
                continue
            before[s] = (loss, beta[s])
            slope = flat[1:k + 1] + ridge * beta[s]
            curve = flat[k + 1:].reshape(k, k) + np.diag(ridge)
            # One class only leaves the intercept without a finite optimum.
            step = np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
            beta[s] = beta[s] - step
            if np.abs(step).max() <= tol * max(1.0, np.abs(beta[s]).max()):
                done.append(s)
        open_sets = [s for s in open_sets if s not in done]
    return beta


def scores(rows: Encoded, set_name: str, beta: np.ndarray, parts: Sequence[int]) -> DataFrame:
    """key, label, p of the rows of some parts."""
    s = rows.sets[set_name]
    schema = T.StructType([rows.rows.schema["key"], rows.rows.schema["label"],
                           T.StructField("p", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            if raw.num_rows:
                batch = read(raw)
                z = np.clip(design(batch, s) @ beta, -700, 700)
                yield pa.RecordBatch.from_arrays(
                    [batch.key, pa.array(batch.label), pa.array(1 / (1 + np.exp(-z)))],
                    names=schema.names)

    return rows.rows.where(F.col("part").isin(*parts)).mapInArrow(score, schema)
