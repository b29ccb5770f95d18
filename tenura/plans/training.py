"""Training, selecting and testing a churn classifier; scoring with the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema
from tenura.operators import attribution, economics, metrics, models, preprocess, quality, splits
from tenura.operators import reports
from tenura.operators.encoded import Encoded, encode
from tenura.sources.artifacts import Artifact
from tenura.sources.scratch import materialize, release

VALIDATION = "validation"
# Files per part at most, and so tasks of a fit per part.
FILES = 256
CV_METRICS = ("roc_auc", "pr_auc", "recall", "f1")
VALIDATION_METRICS = ("precision", "recall", "f1", "roc_auc", "pr_auc")


@dataclass(frozen=True)
class Training:
    """Everything a run leaves behind."""

    artifact: Artifact
    comparison: DataFrame
    curve: DataFrame
    report: DataFrame
    data: DataFrame


def split_table(
    features: DataFrame, params: schema.RunParams, by_part: bool = True
) -> DataFrame:
    """The feature table with split and fold, stored.

    ``by_part`` makes a folder per part, so that each of many fits reads only its own.
    """
    parted = splits.stratified(
        features, seed=params.seed, test=params.test_share,
        validation=params.validation_share, folds=params.folds)
    if not by_part:
        return materialize(parted, "parts")
    # Rows of a part meet in as many tasks as the key's hash deals them to, so its folder gets
    # one file from each of them and not one from every input task.
    dealt = parted.repartition("split", "fold", F.pmod(F.xxhash64(schema.KEY), F.lit(FILES)))
    return materialize(dealt, "parts", ("split", "fold"))


def fit_sets(folds: int) -> dict[str, list[preprocess.Part]]:
    """Row sets to fit on: the training rows without each fold, all of them, and the refit's."""
    train = [("train", k) for k in range(folds)]
    sets = {f"cv{k}": [p for p in train if p != ("train", k)] for k in range(folds)}
    sets["train"] = train
    sets["final"] = [*train, (VALIDATION, None)]
    return sets


def input_columns(features: DataFrame) -> tuple[list[str], list[str]]:
    """Model inputs as (numeric, categorical)."""
    skip = (schema.KEY, schema.LABEL, "split", "fold")
    return schema.numeric_columns(features, skip), schema.string_columns(features, skip)


def held_out_parts(folds: int) -> dict[str, preprocess.Part]:
    """The part that scores each fit set's models: the fold left out, and the validation rows."""
    return {**{f"cv{k}": ("train", k) for k in range(folds)}, "train": (VALIDATION, None)}


def _fit_all(
    rows: Encoded, candidates: Sequence[models.Candidate], folds: int
) -> tuple[dict[str, models.Fits], DataFrame]:
    """Every candidate's fits, and its scores of rows that the fits haven't seen.

    Candidates are fitted side by side: each is a sequence of short passes over the same rows.
    """
    spark = rows.rows.sparkSession
    with ThreadPool(max(len(candidates), 1)) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(lambda c: c.fit_sets(rows)),
                          candidates, chunksize=1)
    fits = {c.name: f for c, f in zip(candidates, fitted)}
    scores = reduce(DataFrame.unionByName, [
        models.held_out_scores(name, f, rows, held_out_parts(folds)) for name, f in fits.items()])
    named = F.when(F.col("part") == "train", VALIDATION).otherwise(F.col("part"))
    return fits, materialize(scores.withColumn("part", named), "scores")


def compare(scores: DataFrame) -> DataFrame:
    """Mean fold metrics and validation metrics per model, from one grouped metric query."""
    by_part = metrics.model_metrics(scores, ["model", "part"])
    held_out = F.col("part") == VALIDATION
    return by_part.groupBy("model").agg(
        *[F.avg(F.when(~held_out, F.col(m))).alias(f"cv_{m}_mean") for m in CV_METRICS],
        *[F.max(F.when(held_out, F.col(m))).alias(f"validation_{m}")
          for m in VALIDATION_METRICS])


def rank_models(comparison: DataFrame) -> DataFrame:
    """Models from best to worst by fold PR-AUC, then recall, then F1."""
    return comparison.orderBy(F.desc("cv_pr_auc_mean"), F.desc("cv_recall_mean"),
                              F.desc("cv_f1_mean"), "model")


def train(
    features: DataFrame,
    candidates: Sequence[models.Candidate] | None = None,
    params: schema.RunParams = schema.RunParams(),
) -> Training:
    """Select a candidate by cross-validation, tune its threshold, refit it and test it once.

    Training rows choose the model, validation rows the threshold, test rows are scored once by
    the refit.
    """
    candidates = list(candidates
                      or models.default_candidates(forest_depth=params.forest_depth))
    spark = features.sparkSession
    numeric, categorical = input_columns(features)
    inputs = [c for c in features.columns if c in {*numeric, *categorical}]
    data = split_table(features.select(schema.KEY, *inputs, schema.LABEL), params)
    sets = fit_sets(params.folds)
    learned = preprocess.fit(data, numeric, categorical, sets)
    encoded = encode(data, numeric, categorical, learned, sets, schema.KEY, schema.LABEL)
    fits, scores = _fit_all(encoded, candidates, params.folds)

    release(spark)

    # One row per candidate.
    ranked = compare(scores)
    rows = rank_models(ranked).collect()
    selected, selection_value = rows[0]["model"], rows[0]["cv_pr_auc_mean"]
    comparison = (spark.createDataFrame(rows, ranked.schema)
                  .withColumn("selected", F.col("model") == selected))

    grid = economics.threshold_grid(params.threshold_start, params.threshold_end,
                                    params.threshold_step)
    validation = scores.filter((F.col("model") == selected) & (F.col("part") == VALIDATION))
    curve = economics.threshold_curve(validation, grid, params.economics)
    best = economics.best_threshold(curve).first().asDict()

    final = models.pipeline(learned["final"], fits[selected].model("final"), data)
    report = test_once(final, data, best, params, selected, inputs, learned["final"].rows,
                       selection_value)
    version = report.first()["model_version"]
    release(spark)
    artifact = Artifact(final, selected, version, best["threshold"], inputs,
                        learned["final"].feature_names)
    return Training(artifact, comparison, curve, report, data)


def test_once(
    model: PipelineModel,
    data: DataFrame,
    best: dict,
    params: schema.RunParams,
    name: str,
    inputs: Sequence[str],
    train_rows: int,
    selection_value: float | None,
) -> DataFrame:
    """The one-row test report of a fitted model at the chosen threshold."""
    test = models.with_probability(model, data.filter(F.col("split") == "test"))
    scored = materialize(test.select("split", schema.LABEL, "p"), "test-scores")
    measured = metrics.model_metrics(scored, ["split"], best["threshold"])
    return materialize(
        reports.test_report(measured, best, params, name, inputs, train_rows, selection_value),
        "test-report")


def score(rows: DataFrame, artifact: Artifact) -> tuple[DataFrame, DataFrame]:
    """(answers for valid rows, rejected rows with violations); no action is run.

    Absent columns get their defaults, and rows that break a rule go to the second frame. Works on
    batch and streaming frames alike.
    """
    valid, rejected = quality.split_valid(quality.fill_absent(rows))
    return _answers(valid, artifact), rejected


def score_table(rows: DataFrame, artifact: Artifact) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``score`` of a whole table, read and checked once: (answers, rejected, rows per rule)."""
    valid, rejected, counts = quality.store_checked(quality.fill_absent(rows))
    return _answers(valid, artifact), rejected, counts


def _answers(valid: DataFrame, artifact: Artifact) -> DataFrame:
    scored = models.with_probability(artifact.pipeline, valid)
    return reports.scored(scored, artifact.model_name, artifact.model_version,
                          artifact.decision_threshold)


def is_linear(artifact: Artifact) -> bool:
    return hasattr(artifact.pipeline.stages[-1], "coefficients")


def tree_importances(artifact: Artifact, spark: SparkSession) -> DataFrame:
    """feature, importance of a tree ensemble, one row per model feature."""
    values = artifact.pipeline.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(artifact.feature_names, values))
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def attributions(artifact: Artifact, rows: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature of a linear winner, in log-odds, over all rows."""
    if not is_linear(artifact):
        raise ValueError(f"{artifact.model_name} is not linear; see tree_importances")
    weights = artifact.pipeline.stages[-1].coefficients.toArray().tolist()
    terms = artifact.pipeline.transform(rows).select(vector_to_array("features").alias("x"))
    return attribution.mean_abs_contribution(
        materialize(terms, "terms"), F.col("x"), weights, artifact.feature_names)
