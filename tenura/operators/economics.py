"""Decision thresholds against retention economics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.functions.scalars import (
    is_number, padded, threshold_grid, with_count_at_or_below,
)
from tenura.schema import Economics

DEFAULT_GRID = tuple(threshold_grid(fv.THRESHOLD_START, fv.THRESHOLD_END, fv.THRESHOLD_STEP))
CURVE_COLUMNS = (
    "threshold", "targeted_customers", "targeted_share", "captured_churners", "recall",
    "precision", "gross_expected_value_inr", "intervention_cost_inr", "net_expected_value_inr",
)


def _curve(counts: DataFrame, by: Sequence[str], money: Economics) -> DataFrame:
    """Rates and money from (threshold, targeted, captured, customers, churners)."""
    gross = f"captured * {money.save_probability!r}D * {money.monthly_margin!r}D"
    cost = f"targeted * {money.intervention_cost!r}D"
    return counts.selectExpr(
        *by,
        "threshold",
        "targeted AS targeted_customers",
        "coalesce(try_divide(targeted, customers), 0D) AS targeted_share",
        "captured AS captured_churners",
        "coalesce(try_divide(captured, churners), 0D) AS recall",
        "coalesce(try_divide(captured, targeted), 0D) AS precision",
        f"{gross} AS gross_expected_value_inr",
        f"{cost} AS intervention_cost_inr",
        f"{gross} - {cost} AS net_expected_value_inr")


def threshold_curve(
    df: DataFrame,
    thresholds: Sequence[float] = DEFAULT_GRID,
    money: Economics = Economics(),
    by: Sequence[str] = (),
    label: str = "churn",
    score: str = "p",
) -> DataFrame:
    """One row per threshold: targeted and captured customers, rates and money.

    Each score is placed once on the threshold grid, rows are counted per grid cell before the
    shuffle, and a threshold's counts are the sums of the cells at or above it. Work per row does
    not depend on the number of thresholds.
    """
    thresholds = sorted(float(t) for t in thresholds)
    grid, size = padded(thresholds)
    valid = f"IF({score} IS NULL OR isnan({score}), double('-Infinity'), {score}) AS _score"
    placed = with_count_at_or_below(
        df.selectExpr(*by, valid, f"coalesce({label}, 0) AS _y"), "_score", grid, size, "_cell")
    cells = placed.groupBy(*by, "_cell").agg(F.expr("count(1) AS n"),
                                             F.expr("sum(CAST(_y AS BIGINT)) AS y"))
    # At most len(thresholds) + 1 cells per group.
    table = cells.groupBy(*by).agg(
        F.expr("coalesce(sum(n), 0) AS customers"), F.expr("coalesce(sum(y), 0) AS churners"),
        F.expr("collect_list(struct(_cell, n, y)) AS cells"))
    literals = ", ".join(f"{t!r}D" for t in thresholds)
    rows = table.selectExpr(*by, "customers", "churners", "cells",
                            f"posexplode(array({literals})) AS (_i, threshold)")
    sums = [f"aggregate(filter(cells, c -> c._cell > _i), 0L, (s, c) -> s + c.{field}) AS {name}"
            for field, name in (("n", "targeted"), ("y", "captured"))]
    return _curve(rows.selectExpr("*", *sums), by, money)


def threshold_curve_direct(
    df: DataFrame,
    thresholds: Sequence[float] = DEFAULT_GRID,
    money: Economics = Economics(),
    label: str = "churn",
    score: str = "p",
) -> DataFrame:
    """The same table by testing every score against every threshold in one aggregate row.

    For short threshold lists, and as the check of ``threshold_curve``.
    """
    thresholds = [float(t) for t in thresholds]
    hits = [f"{score} >= {t!r}D AND NOT isnan({score})" for t in thresholds]
    counts = df.agg(
        F.expr("count(1) AS customers"), F.expr(f"count_if({label} = 1) AS churners"),
        *[F.expr(f"count_if({hit}) AS targeted_{i}") for i, hit in enumerate(hits)],
        *[F.expr(f"count_if({hit} AND {label} = 1) AS captured_{i}")
          for i, hit in enumerate(hits)])
    rows = ", ".join(
        f"named_struct('threshold', {t!r}D, 'targeted', targeted_{i}, 'captured', captured_{i})"
        for i, t in enumerate(thresholds))
    return _curve(counts.selectExpr("customers", "churners", f"inline(array({rows}))"),
                  (), money)


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row of greatest net value, the lowest threshold among equals."""
    rest = [c for c in curve.columns if c not in by]
    net = F.col("net_expected_value_inr")
    best = F.max_by(F.struct(*rest), F.when(is_number(net), F.struct(net, -F.col("threshold"))))
    return curve.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")

