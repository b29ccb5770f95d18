"""The whole run: profile, features, training, attribution, and every report written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema
from tenura.operators import attribution, economics, models, profile, quality, reports
from tenura.plans import features as plans
from tenura.plans import training
from tenura.sources import artifacts, sinks, tables
from tenura.sources.scratch import materialize


def check_base_tables(customers: DataFrame, usage: DataFrame) -> DataFrame:
    """Broken integrity rules of the base tables: table, rule, column, violations."""
    rules = []
    for table, name, declared, key in (
            (customers, "customers", schema.CUSTOMERS, schema.CUSTOMERS_KEY),
            (usage, "customer_monthly_usage", schema.USAGE, schema.USAGE_KEY)):
        nulls = quality.not_null_violations(table, declared.fieldNames(), name)
        rules.append(nulls.selectExpr("table_name", "'not null' AS rule", "column_name",
                                      "violations"))
        repeated = quality.duplicate_keys(table, key).agg(F.count(F.lit(1)).alias("violations"))
        rules.append(repeated.selectExpr(f"'{name}' AS table_name", "'unique key' AS rule",
                                         f"'{','.join(key)}' AS column_name", "violations"))
    broken = rules[0]
    for rule in rules[1:]:
        broken = broken.unionByName(rule)
    return broken.filter("violations > 0")


def write_profile(customers: DataFrame, out: str) -> None:
    numeric = schema.numeric_columns(customers)
    sinks.write_document(
        reports.profile_document(
            quality.table_facts(customers, schema.KEY, schema.LABEL),
            profile.numeric_profile(customers, numeric)),
        f"{out}/eda_summary.json")
    sinks.write_table(profile.churn_rate_by(customers, "plan_name"), f"{out}/churn_by_plan.csv")
    sinks.write_table(profile.churn_rate_by_tenure(customers), f"{out}/churn_by_tenure.csv")
    sinks.write_table(profile.class_distribution(customers), f"{out}/churn_distribution.csv")


def write_training(run: training.Training, out: str) -> None:
    artifact = run.artifact
    sinks.write_table(run.comparison, f"{out}/model_comparison.csv")
    sinks.write_table(run.curve.orderBy("threshold"), f"{out}/roi_thresholds.csv")
    sinks.write_document(economics.best_threshold(run.curve), f"{out}/roi_optimal.json")
    sinks.write_document(run.report, f"{out}/test_metrics.json")
    row = F.struct(*run.comparison.columns)
    order = F.struct(-F.col("cv_pr_auc_mean"), -F.col("cv_recall_mean"), -F.col("cv_f1_mean"),
                     "model", row.alias("row"))
    # One row per candidate.
    selection = run.comparison.agg(
        F.transform(F.sort_array(F.collect_list(order)), lambda r: r["row"]).alias("comparison"),
    ).select(
        F.lit(artifact.model_name).alias("selected_model"),
        F.lit(reports.SELECTION_METRIC).alias("selection_metric"),
        F.lit(artifact.model_version).alias("model_version"), "comparison")
    sinks.write_document(selection, f"{out}/model_selection.json")


def write_drivers(run: training.Training, out: str) -> None:
    """Attributions of a linear winner, all and the strongest; else the trees' importances."""
    if training.is_linear(run.artifact):
        importance = training.attributions(run.artifact, run.data)
        sinks.write_table(importance, f"{out}/shap_features.csv")
        sinks.write_table(attribution.top_features(importance), f"{out}/shap_top_features.csv")
    else:
        sinks.write_table(training.tree_importances(run.artifact, run.data.sparkSession),
                          f"{out}/feature_importances.csv")


def run_all(
    spark: SparkSession,
    customers_path: str,
    usage_path: str,
    out: str,
    candidates: Sequence[models.Candidate] | None = None,
    params: schema.RunParams = schema.RunParams(),
) -> training.Training:
    """Read both base tables, check them, and write features, reports and model under ``out``."""
    customers = tables.read_customers(spark, customers_path)
    usage = tables.read_usage(spark, usage_path)
    # One row per broken rule.
    broken = check_base_tables(customers, usage).collect()
    if broken:
        raise ValueError(f"base tables break integrity rules: {broken}")
    write_profile(customers, f"{out}/reports")
    features = plans.feature_table(customers, usage)
    sinks.write_table(features, f"{out}/model_features.parquet")
    stored = tables.read_report(spark, f"{out}/model_features.parquet", features.schema)
    run = training.train(stored, candidates, params)
    run = training.Training(run.artifact, run.comparison, materialize(run.curve, "curve"),
                            run.report, run.data)
    write_training(run, f"{out}/reports")
    artifacts.save(run.artifact, spark, f"{out}/model")
    write_drivers(run, f"{out}/reports")
    return run
