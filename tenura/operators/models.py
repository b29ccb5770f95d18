"""Candidate classifiers, fitted for all fit sets together.

A candidate learns from the encoded rows of every fit set in shared passes (``newton``, ``trees``).
What it leaves are pyspark.ml models over the ``features`` vector of the preprocessing: Spark's own
for weights and for few small trees, a stage with the nodes in arrays for a forest (``forest_model``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from py4j.java_gateway import JavaObject
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura import schema
from tenura.operators import newton, trees
from tenura.operators.encoded import Encoded, FillSet, encode
from tenura.operators.forest_model import ForestModel, Nodes, narrow
from tenura.operators.preprocess import Part, Preprocessing, in_parts, to_stages

Weights = dict[str, tuple[float, float]]


def balanced_weights(p: Preprocessing) -> tuple[float, float]:
    """Weights n / (2 n_class) of class 0 and class 1; they sum to n over the rows."""
    negatives, positives = max(p.negatives, 1), max(p.positives, 1)
    return p.rows / (2 * negatives), p.rows / (2 * positives)


def positive_weights(p: Preprocessing) -> tuple[float, float]:
    """Class 1 weighted by the negatives per positive."""
    return 1.0, max(p.negatives, 1) / max(p.positives, 1)


@dataclass(frozen=True)
class Fits:
    """A candidate's fits: scores of some parts by one set's fit, and that fit as a Spark model."""

    scores: Callable[[str, list[int]], DataFrame]  # key, label, p
    model: Callable[[str], Model]


@dataclass(frozen=True)
class Candidate:
    """A named classifier: its class weights and how it is fitted."""

    name: str
    weights: Callable[[Preprocessing], tuple[float, float]]
    fit_all: Callable[[Encoded, Weights], Fits]

    def fit_sets(self, rows: Encoded) -> Fits:
        return self.fit_all(rows, {s: self.weights(f.preprocessing)
                                   for s, f in rows.sets.items()})


def logistic_regression(max_iter: int = 2000) -> Candidate:
    """L2-penalised with unit strength; the penalty leaves the intercept out."""

    def fit_all(rows: Encoded, weights: Weights) -> Fits:
        beta = newton.fit(rows, weights, penalty=1.0, max_iter=max_iter)
        spark = rows.rows.sparkSession
        return Fits(lambda s, parts: newton.scores(rows, s, beta[s], parts),
                    lambda s: _logistic_model(spark, beta[s]))

    return Candidate("LogisticRegression", balanced_weights, fit_all)


def random_forest(trees_: int = 350, depth: int = 12, min_leaf: int = 5) -> Candidate:
    """Depth is bounded: a distributed forest grows level by level over all rows."""

    def fit_all(rows: Encoded, weights: Weights) -> Fits:
        f = trees.Forest(trees_, depth, min_leaf, fv.SEED)
        grown = trees.grow_forest(rows, weights, f)
        return Fits(
            lambda s, parts: trees.forest_scores(rows, s, grown, parts, depth),
            lambda s: _forest_model(grown, s, rows, rows.sets[s]))

    return Candidate("RandomForest", balanced_weights, fit_all)


def boosted_trees(rounds: int = 250, depth: int = 3) -> Candidate:
    """Second-order boosting of the logistic loss, its rows and columns sampled per tree."""

    def fit_all(rows: Encoded, weights: Weights) -> Fits:
        b = trees.Boosting(rounds=rounds, depth=depth, seed=fv.SEED)
        grown, margins = trees.boost(rows, weights, b)

        def scores(s: str, parts: list[int]) -> DataFrame:
            margin = F.get("margins", F.lit(rows.names.index(s)))
            return margins.where(F.col("part").isin(*parts)).select(
                "key", "label", (1 / (1 + F.exp(-margin))).alias("p"))

        return Fits(scores, lambda s: _boosted_model(rows.rows.sparkSession, grown[s], rows,
                                                     rows.sets[s]))

    return Candidate("GradientBoostedTrees", positive_weights, fit_all)


def default_candidates(
    max_iter: int = 2000, trees_: int = 350, rounds: int = 250, forest_depth: int = 12
) -> list[Candidate]:
    return [logistic_regression(max_iter), random_forest(trees_, forest_depth),
            boosted_trees(rounds)]


def pipeline(p: Preprocessing, model: Model, rows: DataFrame) -> PipelineModel:
    """Preprocessing and classifier over raw rows like ``rows``, of which only the schema counts."""
    return PipelineModel(stages=[*to_stages(p, rows).stages, model])


def fit(
    candidate: Candidate, learned: Mapping[str, Preprocessing], data: DataFrame,
    sets: Mapping[str, Sequence[Part]], label: str = schema.LABEL,
) -> dict[str, PipelineModel]:
    """The fitted pipelines of all sets, for a table that carries ``split`` and ``fold``."""
    numeric = _in_order(data, [p.medians for p in learned.values()])
    categorical = _in_order(data, [p.categories for p in learned.values()])
    rows = encode(data, numeric, categorical, learned, sets, schema.KEY, label)
    fits = candidate.fit_sets(rows)
    return {s: pipeline(learned[s], fits.model(s), data) for s in sets}


def _in_order(data: DataFrame, found: Sequence[Mapping]) -> list[str]:
    return [c for c in data.columns if any(c in names for names in found)]


def held_out_scores(name: str, fits: Fits, rows: Encoded,
                    parts: Mapping[str, Part]) -> DataFrame:
    """model, part (the fit set's name), key, label, p of a part that each set's fit hasn't seen."""
    tables = [fits.scores(s, [rows.parts.index(part)]).select(
        F.lit(name).alias("model"), F.lit(s).alias("part"), F.col("key").alias(rows.key),
        F.col("label").cast("int").alias(schema.LABEL), "p")
        for s, part in parts.items() if part in rows.parts]
    return reduce(DataFrame.unionByName, tables)


def with_probability(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    """Rows with the probability of class 1; the model's working columns are dropped."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(out))


# ------------------------------------------------------------- fits as models that Spark stores


def _logistic_model(spark: SparkSession, beta: np.ndarray) -> LogisticRegressionModel:
    ml = spark.sparkContext._jvm.org.apache.spark.ml.classification
    weights = _py2java(spark.sparkContext, Vectors.dense(beta[:-1]))
    return LogisticRegressionModel(
        ml.LogisticRegressionModel("logistic_newton", weights, float(beta[-1])))


def _feature_places(rows: Encoded, s: FillSet) -> dict[tuple[int, int], int]:
    """The vector's place of a numeric input (i, 0) and of a category (input, code)."""
    places = {(int(i), 0): n for n, i in enumerate(s.numeric)}
    start = len(places)
    for j, known in enumerate(s.known):
        for code in np.flatnonzero(known >= 0):
            places[len(rows.numeric) + j, int(code)] = start + int(known[code])
        start += int((known >= 0).sum())
    return places


def _root(spark: SparkSession, tree: trees.Tree, rows: Encoded, s: FillSet,
          places: dict[tuple[int, int], int], impurity: Callable[[tuple], JavaObject],
          count: Callable[[tuple], float], value: Callable[[float], float]) -> JavaObject:
    """A tree's nodes as Spark's, leaves first."""
    made = spark.sparkContext._jvm.org.apache.spark.ml.tree
    nodes: list[JavaObject | None] = [None] * len(tree.col)
    for i in reversed(range(len(tree.col))):
        stats, col = tree.stats[i], tree.col[i]
        if col < 0:
            nodes[i] = made.LeafNode(value(tree.value[i]), 0.0, impurity(stats))
            continue
        if col < tree.inputs:
            cut = (rows.cuts[col][tree.cut[i]] - s.means[col]) / s.scales[col]
            split = made.ContinuousSplit(places[col, 0], float(cut))
        else:
            split = made.ContinuousSplit(places[col, tree.cut[i]], 0.5)
        gain = tree.gain[i] / max(count(stats), 1e-300)
        left = tree.left[i]
        nodes[i] = made.InternalNode(value(tree.value[i]), 0.0, float(gain), nodes[left],
                                     nodes[left + 1], split, impurity(stats))
    return nodes[0]


def _doubles(spark: SparkSession, values: Sequence[float]) -> JavaObject:
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def _forest_model(grown: trees.Forests, name: str, rows: Encoded, s: FillSet) -> ForestModel:
    places, width = _feature_places(rows, s), len(s.preprocessing.feature_names)
    categories = max([1, *rows.sizes()[len(rows.numeric):]])
    # The vector's place of (input, code); a numeric input has one, whatever the code.
    table = np.full((len(rows.numeric) + len(rows.categorical), categories), -1, np.int64)
    for (i, code), place in places.items():
        table[i, slice(None) if i < len(rows.numeric) else code] = place
    edges = np.full((len(rows.numeric), max([1, *map(len, rows.cuts)])), np.nan)
    for i, cut in enumerate(rows.cuts):
        edges[i, :len(cut)] = (cut - s.means[i]) / s.scales[i]
    parts, starts, total = [], [], np.zeros(width)
    for own in grown.each(name, ["place", "col", "cut", "gain", "value"]):
        col, cut, inner = own["col"], own["cut"], own["col"] >= 0
        numeric = inner & (col < len(rows.numeric))
        feature, number = np.full(len(col), -1), np.where(inner, 0.5, own["value"])
        feature[inner] = table[col[inner], np.where(numeric, 0, cut)[inner]]
        number[numeric] = edges[col[numeric], cut[numeric]]
        gains = np.bincount(feature[inner], own["gain"][inner], width)
        total += gains / gains.sum() if gains.sum() > 0 else 0.0
        starts.append(starts[-1] + len(parts[-1][0]) if parts else 0)
        parts.append((narrow(feature), narrow(trees.left_children(own)), number))
    nodes = Nodes(np.array(starts, np.int64), *(np.concatenate(c) for c in zip(*parts)))
    return ForestModel(nodes=nodes, importances=(total / (total.sum() or 1.0)).tolist())


def _boosted_model(spark: SparkSession, grown: Sequence[trees.Tree], rows: Encoded,
                   s: FillSet) -> GBTClassificationModel:
    """Spark's margin is half of the log-odds, so leaves are halved."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    places, width = _feature_places(rows, s), len(s.preprocessing.feature_names)

    def impurity(stats: tuple) -> JavaObject:
        return variance(_doubles(spark, (max(stats[1], 1e-300), stats[0], 0.0)), int(stats[1]))

    regression = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(regression, len(grown))
    for i, tree in enumerate(grown):
        root = _root(spark, tree, rows, s, places, impurity, lambda x: x[1], lambda v: v / 2)
        array[i] = regression(f"round_{i}", root, width)
    model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        "boosted_by_levels", array, _doubles(spark, [1.0] * len(grown)), width, 2)
    return GBTClassificationModel(model)
