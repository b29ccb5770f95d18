"""The whole run from files to reports."""

import pytest

from tenura import schema
from tenura.operators import models
from tenura.plans import workflow
from tenura.sources import artifacts, binding, scratch, sinks, tables


@pytest.fixture(scope="module")
def stored(spark, medium, tmp_path_factory):
    folder = tmp_path_factory.mktemp("base")
    sinks.write_table(binding.customers(spark, medium), f"{folder}/customers.csv")
    sinks.write_table(binding.usage(spark, medium), f"{folder}/usage.parquet")
    return f"{folder}/customers.csv", f"{folder}/usage.parquet"


def test_run_writes_every_report(spark, stored, tmp_path):
    out = str(tmp_path)
    run = workflow.run_all(spark, *stored, out, [models.logistic_regression()],
                           schema.RunParams(folds=2))
    made = {p.name for p in (tmp_path / "reports").iterdir()}
    assert made == {
        "eda_summary.json", "churn_by_plan.csv", "churn_by_tenure.csv", "churn_distribution.csv",
        "model_comparison.csv", "roi_thresholds.csv", "roi_optimal.json", "test_metrics.json",
        "model_selection.json", "shap_features.csv", "shap_top_features.csv"}
    report = tables.read_report(spark, f"{out}/reports/test_metrics.json").first()
    assert report["model_version"] == run.artifact.model_version
    assert tables.read_report(spark, f"{out}/reports/roi_thresholds.csv").count() == 86
    best = tables.read_report(spark, f"{out}/reports/roi_optimal.json").first()
    assert best["threshold"] == run.artifact.decision_threshold
    drivers = tables.read_report(spark, f"{out}/reports/shap_top_features.csv")
    assert drivers.count() == 30 and drivers.columns == ["feature", "mean_abs_shap"]
    selection = tables.read_report(spark, f"{out}/reports/model_selection.json").first()
    assert selection["selected_model"] == selection["comparison"][0]["model"]
    summary = tables.read_report(spark, f"{out}/reports/eda_summary.json").first()
    assert summary["rows"] == 1500
    assert summary["numeric_summary"]["tenure_months"]["mean"] == pytest.approx(39.645)
    assert summary["numeric_summary"]["tenure_months"]["p50"] == 45.0
    assert artifacts.load(spark, f"{out}/model").feature_names == run.artifact.feature_names
    assert tables.read_report(spark, f"{out}/model_features.parquet").count() == 1500


def test_broken_tables_are_refused(spark, stored, tmp_path):
    customers = tables.read_customers(spark, stored[0])
    twice = customers.unionByName(customers.limit(1))
    rules = workflow.check_base_tables(twice, tables.read_usage(spark, stored[1])).collect()
    assert [tuple(r) for r in rules] == [("customers", "unique key", "customer_id", 1)]
    path = f"{tmp_path}/twice.parquet"
    sinks.write_table(twice, path)
    with pytest.raises(ValueError, match="unique key"):
        workflow.run_all(spark, path, stored[1], str(tmp_path / "out"))


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    stored = scratch.materialize(spark.range(10), "numbers")
    assert stored.count() == 10
    kept = f"{tmp_path}/other"
    spark.range(1).write.parquet(kept)
    scratch.clear(spark)
    assert spark.read.parquet(kept).count() == 1
    with pytest.raises(Exception, match="does not exist|not found|FileNotFound"):
        spark.range(0).unionByName(stored).collect()
    assert scratch.materialize(spark.range(3), "numbers").count() == 3
