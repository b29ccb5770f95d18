"""Preprocessing, fits, the training run, attribution, scoring and stored artifacts."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.operators import attribution, models, preprocess, reports
from tenura.plans import catalog, training
from tenura.schema import Economics, RunParams
from tenura.sources import artifacts, tables, sinks
from tenura.sources.scratch import materialize
from tenura.streaming import scoring

ALL = {"all": [("train", 0), ("train", 1)]}


def parted(df):
    return df.selectExpr("*", "'train' AS split", "CAST(customer_id % 2 AS INT) AS fold")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(0, 1.0, 5.0, "a", 0), (1, 2.0, 5.0, "b", 1), (2, 4.0, 5.0, "c", 0),
            (3, None, 5.0, "b", 1), (4, float("nan"), 5.0, None, 0)]
    return parted(spark.createDataFrame(
        rows, "customer_id long, x double, flat double, s string, churn int"))


def vectors(p, df):
    out = preprocess.to_stages(p, df).transform(df)
    return {r["customer_id"]: r["v"] for r in
            out.select("customer_id", vector_to_array("features").alias("v")).collect()}


def test_learned_values(mixed):
    p = preprocess.fit(mixed, ["x", "flat"], ["s"], ALL)["all"]
    assert p.medians == {"x": 2.0, "flat": 5.0} and p.modes == {"s": "b"}
    assert p.categories == {"s": ["a", "b", "c"]}
    assert (p.rows, p.positives, p.negatives) == (5, 2, 3)
    filled = [1, 2, 4, 2, 2]
    assert p.means["x"] == pytest.approx(np.mean(filled))
    assert p.scales["x"] == pytest.approx(np.std(filled)) and p.scales["flat"] == 1.0
    assert p.feature_names == ["num__x", "num__flat", "cat__s_a", "cat__s_b", "cat__s_c"]


def test_vectors(spark, mixed):
    p = preprocess.fit(mixed, ["x", "flat"], ["s"], ALL)["all"]
    got = vectors(p, mixed)
    z = (np.array([1, 2, 4, 2, 2]) - 2.2) / np.std([1, 2, 4, 2, 2])
    hot = {0: [1, 0, 0], 1: [0, 1, 0], 2: [0, 0, 1], 3: [0, 1, 0], 4: [0, 1, 0]}
    for i in range(5):
        assert got[i] == pytest.approx([z[i], 0.0, *hot[i]])
    unseen = spark.createDataFrame([(9, 2.2, 5.0, "z'\\")],
                                   "customer_id long, x double, flat double, s string")
    assert vectors(p, unseen)[9] == pytest.approx([0, 0, 0, 0, 0])


def test_two_rows_of_mixed_types(spark):
    df = parted(spark.createDataFrame(
        [(0, 3, "Indore", 2.0, 0), (1, 20, "Mumbai", 6.0, 1)],
        "customer_id long, tenure_months int, city string, avg_data_gb double, churn int"))
    p = preprocess.fit(df, ["tenure_months", "avg_data_gb"], ["city"], ALL)["all"]
    got = vectors(p, df)
    assert len(got) == 2 and got[0] == pytest.approx([-1, -1, 1, 0])


def test_fit_sets_learned_together_equal_single_fits(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.gauss(i % 3, 1) if i % 11 else None, rnd.choice("xyzw"), i % 2, "train", i % 3)
            for i in range(400)]
    df = spark.createDataFrame(
        rows, "customer_id long, x double, s string, churn int, split string, fold int")
    sets = {f"cv{k}": [("train", j) for j in range(3) if j != k] for k in range(3)}
    learned = preprocess.fit(df, ["x"], ["s"], sets)
    modes = {r["weight"]: r["mode"] for r in preprocess.fit_modes(df, ["s"], sets).collect()}
    for k in range(3):
        inside = [r for r in rows if r[5] != k]
        known = [r[1] for r in inside if r[1] is not None]
        median = np.median(known)
        filled = known + [median] * (len(inside) - len(known))
        p = learned[f"cv{k}"]
        assert p.medians["x"] == pytest.approx(median)
        assert p.means["x"] == pytest.approx(np.mean(filled))
        assert p.scales["x"] == pytest.approx(np.std(filled))
        letters = [r[2] for r in inside]
        expected = min(set(letters), key=lambda v: (-letters.count(v), v))
        assert p.modes["s"] == expected == modes[f"cv{k}"]


def test_constant_columns_are_not_scaled(spark):
    rows = [(i, 0.1, 0.1 if i % 5 else None, i % 2, "train", min(i // 300, 3)) for i in range(997)]
    df = spark.createDataFrame(
        rows, "customer_id long, a double, b double, churn int, split string, fold int")
    p = preprocess.fit(df, ["a", "b"], [], {"all": [("train", k) for k in range(4)]})["all"]
    assert p.scales == {"a": 1.0, "b": 1.0} and p.means == {"a": 0.1, "b": 0.1}
    new = spark.createDataFrame([(1, 0.2, None)], "customer_id long, a double, b double")
    got = preprocess.to_stages(p, new).transform(new).first()["features"].toArray()
    assert got == pytest.approx([0.1, 0.0])


def test_too_many_categories_are_refused(spark, monkeypatch):
    counts = spark.range(50).selectExpr("'c' AS feature", "CAST(id AS STRING) AS value")
    with pytest.raises(ValueError, match="c: 50"):
        preprocess.refuse_wide_columns(counts, 49)
    preprocess.refuse_wide_columns(counts, 50)


def newton(x, y, w, penalty):
    """Weighted logistic regression with an unpenalised intercept, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        gradient = a.T @ (w * (p - y)) + ridge @ beta
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 2)) * [1, 3]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1] - 1)))).astype(int)
    df = parted(spark.createDataFrame(
        [(i, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(n)],
        "customer_id long, a double, b double, churn int"))
    p = preprocess.fit(df, ["a", "b"], [], ALL)["all"]
    assert sum(w * c for w, c in zip(models.balanced_weights(p), (p.negatives, p.positives))) \
        == pytest.approx(n)
    model = models.fit(models.logistic_regression(), {"all": p}, df, ALL)["all"]
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    beta = newton(z, y, w, 1.0)
    linear = model.stages[-1]
    assert [*linear.coefficients, linear.intercept] == pytest.approx(beta, abs=1e-8)


def test_class_weights():
    p = preprocess.Preprocessing({}, {}, {}, {}, {}, rows=100, positives=20)
    assert models.balanced_weights(p) == (0.625, 2.5) and models.positive_weights(p) == (1.0, 4.0)


@pytest.fixture(scope="module")
def planted(spark, medium):
    """Features of the bound data with a learnable label drawn from the scorecard."""
    scored = catalog._scores(spark, medium)
    share = "CAST(conv(substr(md5(concat('y:', customer_id)), 1, 8), 16, 10) AS DOUBLE) / 4294967296"
    features = scored.withColumn("churn", F.expr(f"IF({share} < p, 1, 0)"))
    return materialize(features.drop("data_usage_trend", "p"), "planted")


@pytest.fixture(scope="module")
def run(planted):
    candidates = [models.logistic_regression(), models.boosted_trees(rounds=3)]
    return training.train(planted, candidates, RunParams(economics=Economics()))


def test_training_run(run, planted):
    rows = run.comparison.collect()
    assert [r["selected"] for r in rows].count(True) == 1
    best = max(rows, key=lambda r: (r["cv_pr_auc_mean"], r["cv_recall_mean"], r["cv_f1_mean"]))
    assert best["selected"] and best["model"] == run.artifact.model_name == "LogisticRegression"
    assert best["cv_roc_auc_mean"] > 0.7
    assert run.curve.count() == 86
    report = run.report.first()
    tested = run.data.filter("split = 'test'").agg(F.count("*"), F.avg("churn")).first()
    assert (report["test_size"], report["test_churn_rate"]) == (tested[0], tested[1])
    assert report["validation_net_expected_value_inr"] == pytest.approx(
        report["validation_gross_expected_value_inr"]
        - report["validation_intervention_cost_inr"])
    assert report["model_version"].startswith("2026.10-") and len(report["model_version"]) == 20
    assert report["model_version"] == run.artifact.model_version
    assert report["selection_value"] == best["cv_pr_auc_mean"]
    assert report["roc_auc"] > 0.65


def test_nested_reports(spark, run, tmp_path):
    nested = reports.metrics_report(run.report)
    path = str(tmp_path / "metrics.json")
    sinks.write_document(nested, path)
    stored = tables.read_report(spark, path, nested.schema).first().asDict(recursive=True)
    assert set(stored) == {"model_name", "model_version", "selection_metric", "dataset",
                           "classification", "ranking", "decision_threshold", "roi"}
    assert stored["dataset"]["test_size"] == run.report.first()["test_size"]
    assert reports.headline(nested).first()["roc_auc"] == stored["ranking"]["roc_auc"]
    assert reports.identity(run.report).first()["status"] == "ok"
    roi = reports.roi_report(run.curve, Economics(), "m", F.lit("v")).first()
    assert len(roi["curve"]) == 86 and roi["optimal"]["threshold"] == run.artifact.decision_threshold
    assert roi["assumptions"].asDict() == {"monthly_margin_inr": 300.0,
                                           "intervention_cost_inr": 30.0,
                                           "save_probability_if_targeted": 0.35}


def test_version_depends_on_identity(spark):
    def version(threshold, rows):
        return spark.range(1).select(reports.model_version(
            RunParams(), "m", threshold, ["a"], F.lit(rows), F.lit(5))).first()[0]

    assert version(0.5, 10) == version(0.50001, 10) != version(0.51, 10) != version(0.51, 11)


def test_feature_names_match_the_vector(run):
    p_rows = run.artifact.pipeline.transform(run.data)
    attrs = p_rows.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    assert [names[i] for i in range(len(names))] == list(run.artifact.feature_names)
    assert len(names) == 40


def test_attribution(run, planted):
    values = {r["feature"]: r["mean_abs_shap"]
              for r in training.attributions(run.artifact, run.data).collect()}
    x = np.array([r[0] for r in run.artifact.pipeline.transform(run.data)
                  .select(vector_to_array("features")).collect()])
    w = run.artifact.pipeline.stages[-1].coefficients.toArray()
    expected = np.abs((x - x.mean(0)) * w).mean(0)
    assert [values[n] for n in run.artifact.feature_names] == pytest.approx(expected)


def test_driver_report(spark):
    importance = spark.createDataFrame(
        [(f"num__f{i}", float(i % 4)) for i in range(12)] + [("num__tenure_months", 9.0)],
        "feature string, mean_abs_shap double")
    report = reports.driver_report(importance, "m", F.lit("v"), 5).first()
    assert report["top_n"] == 5 and report["method"] == "SHAP"
    assert [d["feature"] for d in report["drivers"]] == [
        "num__tenure_months", "num__f11", "num__f3", "num__f7", "num__f10"]
    assert report["drivers"][0]["display_name"] == "Tenure"
    assert reports.driver_report(importance, "m", F.lit("v"), 30).first()["top_n"] == 13
    for n in (0, 31):
        with pytest.raises(ValueError):
            reports.named_drivers(importance, n)
    assert attribution.top_features(importance, 2).count() == 2


RECORD = dict(
    customer_id=1, city="Indore", city_tier=2, plan_name="Jio 299",
    autopay_type="Manual Recharge", tenure_months=10, tenure_bucket="7-12", support_tickets=4,
    contract_type="Monthly", data_cap_gb=6.0, avg_data_gb=4.0, avg_calls=200.0,
    avg_days_since_recharge=16.0, max_days_since_recharge=24.0, avg_recharge_amount_inr=300.0,
    recharge_frequency=6.0, avg_rolling_3m_data_gb=3.8, usage_increase_months=1.0,
    avg_monthly_data_delta=-0.6, max_rolling_recharge_recency=24.0)


def test_scoring_a_record(spark, run):
    rows = spark.createDataFrame([RECORD, {**RECORD, "customer_id": 2, "city_tier": 9}])
    answers, rejected = training.score(rows, run.artifact)
    row = answers.collect()
    assert len(row) == 1 and row[0]["customer_id"] == 1
    assert 0 <= row[0]["churn_probability"] <= 1
    assert row[0]["churn_probability"] == round(row[0]["churn_probability"], 4)
    assert row[0]["high_risk"] == (row[0]["churn_probability"] >= run.artifact.decision_threshold)
    assert row[0]["top_reasons"] == [fv.REASON_RECHARGE, fv.REASON_SUPPORT, fv.REASON_USAGE]
    assert rejected.select("customer_id", "violations").collect() == [(2, ["city_tier:range"])]
    sparse, _ = training.score(spark.createDataFrame([(5,)], "customer_id long"), run.artifact)
    assert sparse.first()["top_reasons"] == [fv.REASON_CONTRACT]


def test_a_table_is_scored_as_its_rows(spark, run):
    rows = spark.createDataFrame([{**RECORD, "customer_id": i, "tenure_months": i % 3}
                                  for i in range(30)])
    answers, rejected = training.score(rows, run.artifact)
    stored, refused, counts = training.score_table(rows, run.artifact)
    assert sorted(stored.collect()) == sorted(answers.collect())
    assert rejected.count() == refused.count() == 10
    assert counts.filter("rows > 0").collect() == [("tenure_months:range", 10)]


def test_artifact_round_trip(spark, run, planted, tmp_path):
    artifacts.save(run.artifact, spark, str(tmp_path / "model"))
    loaded = artifacts.load(spark, str(tmp_path / "model"))
    assert loaded.model_version == run.artifact.model_version
    assert list(loaded.features) == list(run.artifact.features)
    before = sorted(training.score(planted, run.artifact)[0].collect())
    after = sorted(training.score(planted, loaded)[0].collect())
    assert before == after and len(before) == 1500


def test_streamed_scores_equal_batch(spark, run, planted, tmp_path):
    source = str(tmp_path / "in")
    rows = planted.withColumn("city_tier", F.expr("IF(customer_id = 3, 9, city_tier)"))
    rows.repartition(3).write.parquet(source)
    stream = scoring.read_rows(spark, source, rows.schema)
    out = [str(tmp_path / n) for n in ("answers", "rejected", "checkpoints")]
    for query in scoring.score_stream(stream, run.artifact, *out):
        query.awaitTermination()
    batch, bad = training.score(rows, run.artifact)
    assert sorted(spark.read.parquet(out[0]).collect()) == sorted(batch.collect())
    assert [r["customer_id"] for r in spark.read.parquet(out[1]).collect()] == [3]
    assert bad.count() == 1


def test_tree_winner_has_importances(spark, planted):
    data = training.split_table(planted, RunParams(), by_part=False)
    numeric, categorical = training.input_columns(data)
    sets = {"train": training.fit_sets(5)["train"]}
    learned = preprocess.fit(data, numeric, categorical, sets)
    p = learned["train"]
    forest = models.fit(models.random_forest(3, depth=4), learned, data, sets)["train"]
    artifact = artifacts.Artifact(forest, "RandomForest", "v", 0.5, numeric, p.feature_names)
    rows = training.tree_importances(artifact, spark).collect()
    assert len(rows) == 40 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        training.attributions(artifact, data)


def test_scoring_needs_no_python_workers(run, planted):
    answers, _ = training.score(planted, run.artifact)
    assert "EvalPython" not in answers._jdf.queryExecution().executedPlan().toString()
