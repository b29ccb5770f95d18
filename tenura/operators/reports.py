"""Model identity, the test report and the nested report documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.functions.naming import display_name, interpretation
from tenura.operators.attribution import top_features
from tenura.operators.economics import CURVE_COLUMNS, best_threshold
from tenura.operators.metrics import decide
from tenura.functions.reasons import top_reasons
from tenura.schema import Economics, RunParams

SELECTION_METRIC = "cv_pr_auc_mean"


def model_version(
    params: RunParams, model: str, threshold: float, features: Sequence[str],
    train_rows: Column, test_rows: Column,
) -> Column:
    """Pipeline version and the first 12 hex digits of a hash over the run's identity."""
    identity = F.to_json(F.struct(
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(model).alias("model"),
        F.lit(params.pipeline_version).alias("pipeline_version"),
        F.lit(params.seed).alias("seed"),
        test_rows.alias("test_rows"),
        F.lit(round(threshold, 4)).alias("threshold"),
        train_rows.alias("train_rows")))
    return F.concat_ws("-", F.lit(params.pipeline_version),
                       F.substring(F.sha2(identity, 256), 1, 12))


def test_report(
    metrics: DataFrame,
    best: Mapping[str, float],
    params: RunParams,
    model: str,
    features: Sequence[str],
    train_rows: int,
    selection_value: float | None,
) -> DataFrame:
    """One flat row: identity, test size and metrics, and the validation economics.

    ``metrics`` is the one-row test result of ``model_metrics``; ``best`` the chosen row of the
    validation threshold curve.
    """
    version = model_version(params, model, best["threshold"], features,
                            F.lit(train_rows).cast("long"), F.col("size"))
    return metrics.select(
        F.lit(model).alias("model_name"),
        version.alias("model_version"),
        F.lit(SELECTION_METRIC).alias("selection_metric"),
        F.lit(selection_value).cast("double").alias("selection_value"),
        F.col("size").alias("test_size"),
        F.col("churn_rate").alias("test_churn_rate"),
        "precision", "recall", "f1", "roc_auc", "pr_auc",
        F.lit(best["threshold"]).alias("validation_optimal_threshold"),
        F.lit(best["targeted_share"]).alias("validation_targeted_share"),
        F.lit(best["captured_churners"]).cast("long").alias("validation_captured_churners"),
        *[F.lit(best[c]).alias(f"validation_{c}")
          for c in ("gross_expected_value_inr", "intervention_cost_inr",
                    "net_expected_value_inr")])


def identity(report: DataFrame) -> DataFrame:
    """Name, version and threshold of the model in use."""
    return report.select(
        F.lit("ok").alias("status"), F.col("model_name").alias("model"), "model_version",
        F.col("validation_optimal_threshold").alias("decision_threshold"))


def metrics_report(report: DataFrame) -> DataFrame:
    """The flat test report grouped into dataset, classification, ranking and roi."""
    return report.select(
        "model_name", "model_version", "selection_metric",
        F.struct("test_size", "test_churn_rate").alias("dataset"),
        F.struct("precision", "recall", "f1").alias("classification"),
        F.struct("roc_auc", "pr_auc").alias("ranking"),
        F.col("validation_optimal_threshold").alias("decision_threshold"),
        F.struct(*[F.col(f"validation_{c}").alias(c) for c in (
            "targeted_share", "captured_churners", "gross_expected_value_inr",
            "intervention_cost_inr", "net_expected_value_inr")]).alias("roi"))


def headline(nested: DataFrame) -> DataFrame:
    """The numbers an overview shows, from the nested metrics report."""
    return nested.select(
        "dataset.test_size", "dataset.test_churn_rate", "ranking.roc_auc", "ranking.pr_auc",
        "decision_threshold", "roi.captured_churners", "roi.targeted_share",
        "roi.gross_expected_value_inr", "roi.intervention_cost_inr",
        "roi.net_expected_value_inr", "model_version", "selection_metric")


def roi_report(
    curve: DataFrame, money: Economics, model: str, version: Column
) -> DataFrame:
    """Assumptions, best row and the whole curve in one nested row, by one aggregate.

    A curve has one row per threshold, so collecting it into an array is bounded by the grid.
    """
    row = F.struct(*CURVE_COLUMNS)
    best = best_threshold(curve).select(F.struct(*CURVE_COLUMNS).alias("optimal"))
    whole = curve.agg(F.sort_array(F.collect_list(row)).alias("curve"))
    # Two tables of one row each, put side by side.
    both = best.unionByName(whole, allowMissingColumns=True)
    return both.agg(F.max("optimal").alias("optimal"), F.first("curve", True).alias("curve")).select(
        F.lit(model).alias("model_name"),
        version.alias("model_version"),
        F.struct(
            F.lit(float(money.monthly_margin)).alias("monthly_margin_inr"),
            F.lit(float(money.intervention_cost)).alias("intervention_cost_inr"),
            F.lit(float(money.save_probability)).alias("save_probability_if_targeted"),
        ).alias("assumptions"),
        "optimal", "curve")


def named_drivers(importance: DataFrame, top_n: int = fv.DRIVERS_DEFAULT) -> DataFrame:
    """The strongest features with display name and interpretation."""
    if not 1 <= top_n <= fv.ATTRIBUTION_TOP:
        raise ValueError(f"top_n must lie in 1..{fv.ATTRIBUTION_TOP}")
    feature = F.col("feature")
    return top_features(importance, top_n).select(
        "feature", display_name(feature).alias("display_name"), "mean_abs_shap",
        interpretation(feature).alias("interpretation"))


def driver_report(
    importance: DataFrame, model: str, version: Column, top_n: int = fv.DRIVERS_DEFAULT
) -> DataFrame:
    """One nested row with the strongest features; ``top_n`` is how many there are."""
    driver = F.struct("feature", "display_name", "mean_abs_shap", "interpretation")
    ranked = F.struct(-F.col("mean_abs_shap"), "feature", driver.alias("driver"))
    return named_drivers(importance, top_n).agg(
        F.transform(F.sort_array(F.collect_list(ranked)), lambda r: r["driver"])
        .alias("drivers"),
    ).select(
        F.lit(model).alias("model_name"), version.alias("model_version"),
        F.lit("SHAP").alias("method"), F.size("drivers").alias("top_n"), "drivers")


def profile_document(facts: DataFrame, profile: DataFrame) -> DataFrame:
    """The table facts with the numeric profile as a map from column name to its statistics."""
    stats = [c for c in profile.columns if c != "feature"]
    summary = profile.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("feature", F.struct(*stats))))).alias("numeric_summary"))
    both = facts.unionByName(summary, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def scored(rows: DataFrame, model: str, version: str, threshold: float,
           key: str = "customer_id") -> DataFrame:
    """Scoring answer per row: rounded probability, decision on the unrounded one, reasons."""
    return rows.select(
        key,
        F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"),
        F.round("p", 4).alias("churn_probability"),
        (decide(F.col("p"), threshold) == 1).alias("high_risk"),
        F.lit(float(threshold)).alias("decision_threshold"),
        top_reasons().alias("top_reasons"))
