"""Global attribution of an additive model: how far each term moves the score on average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as fv


def mean_abs_contribution(
    rows: DataFrame, terms: Column, weights: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """feature, mean |w (x - mean x)| for an array column of model terms.

    Two wide aggregates over all rows: the means, which are one number per term, and then the mean
    distances from them. Without rows there are no features.
    """
    n = len(names)
    x = rows.select(terms.alias("x"))
    means = x.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(n)]).first()
    if any(m is None for m in means):
        return rows.sparkSession.createDataFrame([], "feature string, mean_abs_shap double")
    moved = x.agg(*[F.avg(F.abs(float(w) * (F.get("x", F.lit(i)) - F.lit(means[i])))).alias(f"c{i}")
                    for i, w in enumerate(weights)])
    pairs = [F.struct(F.lit(name).alias("feature"), F.col(f"c{i}").alias("mean_abs_shap"))
             for i, name in enumerate(names)]
    return moved.select(F.inline(F.array(*pairs)))


def top_features(importance: DataFrame, n: int = fv.ATTRIBUTION_TOP) -> DataFrame:
    """The n features of greatest importance, ties by name."""
    return importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(n)


def scorecard_terms() -> tuple[Column, list[float], list[str]]:
    """Terms, weights and names of the linear scorecard."""
    columns = [F.col(c).cast("double") for c in fv.SCORECARD_SLOPES]
    weights = list(fv.SCORECARD_SLOPES.values())
    names = [f"num__{c}" for c in fv.SCORECARD_SLOPES]
    for name, values, weight in fv.SCORECARD_FLAGS:
        columns.append(F.col(name).isin(*values).cast("double"))
        weights.append(weight)
        names.append(f"cat__{name}_{'+'.join(values)}")
    return F.array(*columns), weights, names
