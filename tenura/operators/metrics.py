"""Threshold and ranking metrics, grouped so that many models and folds need one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.scalars import at_or_above
from tenura.operators.ordering import ordered_prefix


def decide(score: Column, threshold: Column | float) -> Column:
    """0/1 decision, inclusive at the threshold."""
    return at_or_above(score, threshold).cast("int")


def threshold_metrics(
    df: DataFrame,
    threshold: Column | float = 0.5,
    by: Sequence[str] = (),
    label: str = "churn",
    score: str = "p",
) -> DataFrame:
    """Size, label rate, confusion counts, precision, recall and F1 in one pass."""
    placed = df.withColumn("_hit", at_or_above(F.col(score), threshold))
    counts = placed.groupBy(*by).agg(
        F.expr("count(1) AS size"),
        F.expr(f"avg({label}) AS churn_rate"),
        F.expr(f"count_if(_hit AND {label} = 1) AS tp"),
        F.expr(f"count_if(_hit AND {label} = 0) AS fp"),
        F.expr(f"count_if(NOT _hit AND {label} = 1) AS fn"))
    return counts.selectExpr(
        "*",
        "coalesce(try_divide(tp, tp + fp), 0D) AS precision",
        "coalesce(try_divide(tp, tp + fn), 0D) AS recall",
        "coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D) AS f1")


def refuse_unscored(df: DataFrame, score: str) -> None:
    """Raise if a score is NULL or NaN: such a row has no place in a ranking."""
    bad = df.filter(f"`{score}` IS NULL OR isnan(`{score}`)").count()
    if bad:
        raise ValueError(f"{bad} rows have no score in {score}")


def ranking_metrics(
    df: DataFrame, by: Sequence[str], label: str = "churn", score: str = "p"
) -> DataFrame:
    """ROC-AUC with ties counted half, and average precision, per group.

    Rows without a score are refused. ``by`` names stored columns with few values, such as model
    and fold. A group without both
    classes has no ROC-AUC; one without positives has average precision 0.
    """
    refuse_unscored(df, score)
    weights = {"pos": f"CAST({label} AS BIGINT)", "neg": f"1 - CAST({label} AS BIGINT)"}
    rows = ordered_prefix(df, by, score, weights, descending=True)
    upto = "(before_pos + pos + before_neg + neg)"
    return (rows.groupBy(*by).agg(
                F.expr("sum(CAST(neg AS DOUBLE) * (before_pos + pos / 2)) AS concordant"),
                F.expr(f"sum(pos * ((before_pos + pos) / {upto})) AS area"),
                F.expr("CAST(max(total_pos) AS DOUBLE) AS p1"),
                F.expr("max(total_neg) AS p0"))
            .selectExpr(*by, "try_divide(concordant, p1 * p0) AS roc_auc",
                        "coalesce(try_divide(area, p1), 0D) AS pr_auc"))


def model_metrics(
    df: DataFrame,
    by: Sequence[str],
    threshold: Column | float = 0.5,
    label: str = "churn",
    score: str = "p",
) -> DataFrame:
    """Threshold and ranking metrics side by side; both sides hold one row per group."""
    left = threshold_metrics(df, threshold, by, label, score)
    return left.join(ranking_metrics(df, by, label, score), list(by), "left")
