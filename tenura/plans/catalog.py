"""The registered queries: each one an operator or a whole report over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura import schema
from tenura import fixed_values as fv
from tenura.functions import naming, reasons, scalars
from tenura.operators import (
    attribution, economics, incremental, metrics, models, panel, preprocess, profile, quality, reports, splits,
)
from tenura.plans import features as plans
from tenura.plans import training
from tenura.schema import Economics, RunParams
from tenura.sources import artifacts, binding, sinks, tables
from tenura.sources.scratch import drop, materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
COSTLY = Economics(intervention_cost=45.0)
SCORE_DIGITS = 10
FEATURE_DOUBLES = (
    "avg_data_gb", "avg_calls", "avg_days_since_recharge", "max_days_since_recharge",
    "avg_recharge_amount_inr", "avg_rolling_3m_data_gb", "avg_monthly_data_delta",
    "max_rolling_recharge_recency",
)
SCORECARD_INPUTS = (
    "city", "plan_name", "autopay_type", "tenure_months", "support_tickets", "contract_type",
    "avg_data_gb", "avg_days_since_recharge", "data_usage_trend",
)
MONEY = ("avg_recharge_amount_inr", "recharge_amount_inr")

# ---------------------------------------------------------------------------------- helpers


def _round(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, 4 if c in MONEY else digits) for c in columns})


def _features(spark: SparkSession, sf_dir: str, trend: bool = False,
              dense: bool = True) -> DataFrame:
    """The binding's panel has six rows per customer at most, so plain windows do."""
    return plans.feature_table(binding.customers(spark, sf_dir),
                               binding.usage(spark, sf_dir, dense), trend)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plans.scorecard(_features(spark, sf_dir, trend=True))
    return scored.withColumn("p", F.round("p", SCORE_DIGITS))


def _stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and scores written once, for the metrics that pass over them several times."""
    scored = _scores(spark, sf_dir).select(F.lit("Scorecard").alias("model"), "churn", "p")
    return materialize(scored, "scores")


def _curve_row(curve: DataFrame) -> DataFrame:
    curve = _round(curve, ("targeted_share", "recall", "precision"))
    return _round(curve, ("gross_expected_value_inr", "intervention_cost_inr",
                          "net_expected_value_inr"), 4)


def _joined(texts: str | Column) -> Column:
    return F.array_join(texts, " | ")


# --------------------------------------------------------------------- features and windows


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_features(spark, sf_dir), FEATURE_DOUBLES)


def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(binding.customers(spark, sf_dir), binding.usage(spark, sf_dir))
    tables.register_features(plans.feature_table(
        spark.table("customers"), spark.table("customer_monthly_usage")))
    return spark.sql("""
        SELECT plan_name, tenure_bucket, count(*) AS customers,
               round(avg(avg_data_gb), 6) AS avg_data_gb
        FROM churn_features GROUP BY plan_name, tenure_bucket""")


def io_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base tables through CSV, the feature table through Parquet, all read back."""
    folder = new_path(spark, "roundtrip")
    sinks.write_table(binding.customers(spark, sf_dir), f"{folder}/customers.csv")
    sinks.write_table(binding.usage(spark, sf_dir), f"{folder}/usage.csv")
    customers = tables.read_customers(spark, f"{folder}/customers.csv")
    usage = tables.read_usage(spark, f"{folder}/usage.csv")
    sinks.write_table(plans.feature_table(customers, usage), f"{folder}/features.parquet")
    return _round(tables.read_report(spark, f"{folder}/features.parquet"), FEATURE_DOUBLES)


def bucketed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table over a stored pair of base tables that share their buckets."""
    folder = new_path(spark, "bucketed")
    suffix = folder.rsplit("-", 1)[-1]
    customers = sinks.write_bucketed(binding.customers(spark, sf_dir), f"customers_{suffix}",
                                     f"{folder}/customers", "customer_id")
    usage = sinks.write_bucketed(binding.usage(spark, sf_dir), f"usage_{suffix}",
                                 f"{folder}/usage", "customer_id", ("month_index",))
    return _round(plans.feature_table(customers, usage), FEATURE_DOUBLES)


def incremental_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table from states that took in the panel's periods one after another."""
    usage = materialize(binding.usage(spark, sf_dir), "panel", ("month_index",))
    state = incremental.empty_state(spark)
    for k in range(1, binding.PERIODS + 1):
        before, state = state, incremental.update(state, usage.filter(F.col("month_index") == k))
        if k > 1:
            drop(before)
    drop(usage)
    behaviour = incremental.behaviour(state)
    return _round(plans.with_behaviour(binding.customers(spark, sf_dir), behaviour),
                  FEATURE_DOUBLES)


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as binding builds it: six rows per customer."""
    return panel.with_windows(binding.usage(spark, sf_dir), bounded=True)


def lag_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir).select("customer_id", "month_index", "data_gb",
                                           "prev_data_gb")


def _rolling(column: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_windowed(spark, sf_dir).select("customer_id", "month_index", column),
                  (column,))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag and rolling mean over every user's whole event sequence, however long it is."""
    events = binding.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    windowed = panel.with_windows(events, "user_id", "event_id", "value", None)
    return _round(windowed, ("rolling_3m_data_gb",))


def _behaviour(columns: tuple[Column, ...], spark: SparkSession, sf_dir: str,
               dense: bool = True) -> DataFrame:
    """Some per-customer aggregates; the windows are computed only if the columns use them."""
    windowed = panel.with_windows(binding.usage(spark, sf_dir, dense), bounded=True)
    out = windowed.groupBy("customer_id").agg(*columns)
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return _round(out, doubles)


def usage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(panel.union_periods(binding.period_frames(spark, sf_dir)),
                  ("recharge_amount_inr",))


def usage_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    trend = (binding.usage(spark, sf_dir, dense=False)
             .groupBy("customer_id").agg(panel.usage_trend()))
    recharges = (panel.union_periods(binding.period_frames(spark, sf_dir))
                 .groupBy("customer_id")
                 .agg(F.avg("recharge_amount_inr").alias("recharge_amount_inr"),
                      F.sum("recharges").alias("recharges")))
    return _round(panel.left_join_all(ids, [trend, recharges], "customer_id"),
                  ("data_usage_trend", "recharge_amount_inr"))


def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = (binding.usage(spark, sf_dir, dense=False)
             .groupBy("customer_id").agg(F.avg("data_gb").alias("avg_data_gb")))
    merged = binding.customers(spark, sf_dir).join(means, "customer_id")
    return _round(merged.select("customer_id", "city", "plan_name", "avg_data_gb"),
                  ("avg_data_gb",))


def plan_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.customers(spark, sf_dir).select(
        "customer_id", "plan_name",
        scalars.plan_price(F.col("plan_name")).alias("list_price_inr"))


def clamped_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(panel.clamped(binding.usage(spark, sf_dir)), ("recharge_amount_inr",))


def clamped_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.clamped_customers(binding.customers(spark, sf_dir)).select(
        "customer_id", "tenure_months", "support_tickets")


def city_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.customers(spark, sf_dir).select(
        "customer_id", "city", scalars.city_tier(F.col("city")).alias("city_tier"))


def tenure_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.customers(spark, sf_dir).select(
        "customer_id", "tenure_months",
        scalars.tenure_bucket(F.col("tenure_months")).alias("tenure_bucket"))


# --------------------------------------------------------------------- quality and profiles


def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = [f.name for f in schema.CUSTOMERS.fields if f.name != "customer_id"]
    return quality.not_null_violations(
        binding.customers(spark, sf_dir), customers, "customers",
    ).unionByName(quality.not_null_violations(
        binding.usage(spark, sf_dir), schema.USAGE.fieldNames(), "customer_monthly_usage"))


def _orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority is missing once they are fulfilled."""
    return binding.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice",
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("pr"))


def not_null_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders_with_gaps(spark, sf_dir)
    return quality.not_null_violations(orders, orders.columns, "orders")


def order_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and priorities that several orders share."""
    return quality.duplicate_keys(_orders_with_gaps(spark, sf_dir).dropna(), ("o_custkey", "pr"))


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = binding.table(spark, sf_dir, "lineitem")
    return quality.duplicate_keys(lines, ("l_orderkey", "l_linenumber"))


def usage_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(binding.usage(spark, sf_dir), schema.USAGE_KEY)


def churn_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.churn_rate_by(binding.customers(spark, sf_dir), "plan_name"),
                  ("churn_rate",))


def churn_by_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.churn_rate_by_tenure(binding.customers(spark, sf_dir)),
                  ("churn_rate",))


def churn_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_distribution(binding.customers(spark, sf_dir))


def profile_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(quality.table_facts(binding.customers(spark, sf_dir), "customer_id", "churn"),
                  ("churn_rate",))


def profile_scalars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts on a table with repeated ids and missing cells."""
    fulfilled = F.col("o_orderstatus") == "F"
    orders = binding.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.when(~fulfilled, F.col("o_orderpriority")).alias("pr"),
        fulfilled.cast("int").alias("flag"))
    return _round(quality.table_facts(orders, "o_custkey", "flag"), ("churn_rate",))


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = binding.customers(spark, sf_dir)
    return profile.numeric_profile(customers, schema.numeric_columns(customers))


def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile as one nested document, as written to a JSON sink and read back."""
    customers = binding.customers(spark, sf_dir)
    document = reports.profile_document(
        quality.table_facts(customers, "customer_id", "churn"),
        profile.numeric_profile(customers, schema.numeric_columns(customers)))
    path = f"{new_path(spark, 'summary')}.json"
    sinks.write_document(document, path)
    stored = tables.read_report(spark, path, document.schema)
    return (_round(stored, ("churn_rate",))
            .select("rows", "columns", "churn_rate", "missing_cells", "duplicate_customer_ids",
                    F.explode("numeric_summary").alias("feature", "s"))
            .select("rows", "columns", "churn_rate", "missing_cells", "duplicate_customer_ids",
                    "feature", "s.count", "s.mean", "s.std", "s.p50"))


# ------------------------------------------------------------------------ scorecard and ROI


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(spark, sf_dir).withColumn("logit", scalars.scorecard_logit())
    return _round(scored.select("customer_id", "logit", "p"), ("logit", "p"))


def scorecard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = reports.scored(_scores(spark, sf_dir), "Scorecard", fv.PIPELINE_VERSION, 0.5)
    return scored.withColumn("top_reasons", _joined("top_reasons"))


def roi_curve_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve_row(economics.threshold_curve(_scores(spark, sf_dir)))


def roi_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = economics.threshold_curve(_scores(spark, sf_dir), money=COSTLY)
    return _curve_row(economics.best_threshold(curve))


def roi_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = economics.threshold_curve(_scores(spark, sf_dir), by=("plan_name",))
    return curve.select("plan_name", "threshold", "targeted_customers", "captured_churners")


def roi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, unnested again into one row per threshold."""
    curve = economics.threshold_curve(_scores(spark, sf_dir), money=COSTLY)
    nested = reports.roi_report(curve, COSTLY, "Scorecard", F.lit(fv.PIPELINE_VERSION))
    return _curve_row(nested.select(
        "model_name", "assumptions.monthly_margin_inr",
        F.col("assumptions.intervention_cost_inr").alias("intervention_cost_inr_per_customer"),
        "assumptions.save_probability_if_targeted",
        F.col("optimal.threshold").alias("optimal_threshold"), F.inline("curve")))


def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.threshold_metrics(_scores(spark, sf_dir)),
                  ("churn_rate", "precision", "recall", "f1"))


def _ranking(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = metrics.ranking_metrics(_stored_scores(spark, sf_dir), ["model"])
    return _round(ranked.select(metric), (metric,))


def _scorecard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold from the validation rows, metrics on the test rows, as one nested report."""
    params = RunParams(economics=COSTLY)
    scored = _scores(spark, sf_dir).select("customer_id", "churn", "p")
    stored = materialize(splits.stratified(materialize(scored, "scores")), "scored-parts")
    validation = stored.filter(F.col("split") == "validation")
    best = economics.best_threshold(
        economics.threshold_curve(validation, money=params.economics)).first().asDict()
    train_rows = stored.filter(F.col("split") != "test").count()
    measured = metrics.model_metrics(stored.filter(F.col("split") == "test"), ["split"],
                                     best["threshold"])
    report = reports.test_report(measured, best, params, "Scorecard", SCORECARD_INPUTS,
                                 train_rows, None)
    return reports.metrics_report(report)


def headline_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an overview shows, written as a JSON report and read back."""
    headline = reports.headline(_scorecard_report(spark, sf_dir))
    path = f"{new_path(spark, 'headline')}.json"
    sinks.write_document(headline, path)
    stored = tables.read_report(spark, path, headline.schema).drop(
        "model_version", "selection_metric")
    stored = _round(stored, ("test_churn_rate", "roc_auc", "pr_auc", "targeted_share"))
    return _round(stored, ("gross_expected_value_inr", "intervention_cost_inr",
                           "net_expected_value_inr"), 4)


def scorecard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report as one flat row."""
    nested = _scorecard_report(spark, sf_dir)
    flat = nested.select("model_name", "model_version", "selection_metric", "dataset.*",
                         "classification.*", "ranking.*", "decision_threshold", "roi.*")
    flat = _round(flat, ("test_churn_rate", "precision", "recall", "f1", "roc_auc", "pr_auc",
                         "targeted_share"))
    return _round(flat, ("gross_expected_value_inr", "intervention_cost_inr",
                         "net_expected_value_inr"), 4)


def scorecard_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, weights, names = attribution.scorecard_terms()
    rows = materialize(_features(spark, sf_dir, trend=True).select(terms.alias("x")), "terms")
    importance = attribution.mean_abs_contribution(rows, F.col("x"), weights, names)
    return _round(attribution.top_features(importance), ("mean_abs_shap",))


# ----------------------------------------------------------------- splits and preprocessing


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = binding.customers(spark, sf_dir).select("customer_id", "churn")
    return splits.stratified(materialize(customers, "labels"))


def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).drop("fold")


def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).filter(F.col("split") == "train").drop("split")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights that fits on the training rows use."""
    sets = {"train": training.fit_sets(fv.CV_FOLDS)["train"]}
    learned = preprocess.fit(materialize(_parts(spark, sf_dir), "parts"), (), (), sets)["train"]
    low, high = models.balanced_weights(learned)
    _, scale = models.positive_weights(learned)
    weights = spark.createDataFrame(
        [(learned.negatives, learned.positives, low, high, scale)],
        "negatives long, positives long, negative_weight double, positive_weight double, "
        "scale_pos_weight double")
    return _round(weights, ("negative_weight", "positive_weight", "scale_pos_weight"))


def _split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feature table with its parts, for a single fit.

    Only (id, label) is needed to find the parts; the wide rows are written once, with them.
    """
    features = _features(spark, sf_dir)
    labels = materialize(features.select("customer_id", "churn"), "labels")
    return materialize(splits.assign(features, splits.fit_boundaries(labels)), "parts")


def impute_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill values as training learns them."""
    data = _split_features(spark, sf_dir)
    numeric, categorical = training.input_columns(data)
    sets = {"train": training.fit_sets(fv.CV_FOLDS)["train"]}
    found = preprocess.fit_medians(data, numeric, sets)["train"]
    medians = spark.createDataFrame([(c, found.get(c), None) for c in numeric],
                                    "feature string, median double, mode string")
    medians = medians.withColumn("median", F.round("median", 6))
    modes = preprocess.fit_modes(data, categorical, sets).select(
        "feature", F.lit(None).cast("double").alias("median"), "mode")
    return medians.unionByName(modes)


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, preprocess.Preprocessing]:
    data = _split_features(spark, sf_dir)
    numeric, categorical = training.input_columns(data)
    sets = {"train": training.fit_sets(fv.CV_FOLDS)["train"]}
    learned = preprocess.fit(data, numeric, categorical, sets)["train"]
    vectors = preprocess.to_stages(learned, data).transform(data)
    return vectors.select("customer_id", vector_to_array("features").alias("x")), learned


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, learned = _encoded(spark, sf_dir)
    return vectors.select("customer_id", *[
        F.round(F.get("x", F.lit(i)), 6).alias(name)
        for i, name in enumerate(learned.feature_names) if name.startswith("num__")])


def standardize_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant column, not exact in binary, beside one that varies."""
    data = materialize(splits.stratified(materialize(binding.customers(spark, sf_dir).select(
        "customer_id", F.lit(0.1).alias("tenth"), "tenure_months", "churn"), "labels")), "parts")
    sets = {"train": training.fit_sets(fv.CV_FOLDS)["train"]}
    learned = preprocess.fit(data, ("tenth", "tenure_months"), (), sets)["train"]
    x = preprocess.to_stages(learned, data).transform(data).select(
        "customer_id", vector_to_array("features").alias("x"))
    return x.select("customer_id", F.col("x")[0].alias("num__tenth"),
                    F.round(F.col("x")[1], 6).alias("num__tenure_months"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, learned = _encoded(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in learned.feature_names])
    return (vectors.select("customer_id", F.posexplode("x").alias("i", "value"))
            .select("customer_id", F.get(names, F.col("i")).alias("feature"), "value")
            .filter(F.col("feature").startswith("cat__") & (F.col("value") != 0)))


# -------------------------------------------------------------------- scoring rows and names


def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a panel with gaps makes unfit for scoring: no second period, so no usage change."""
    _, rejected = quality.split_valid(_features(spark, sf_dir, dense=False))
    return rejected.select("customer_id", _joined("violations").alias("violations"))


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, where tenure is taken a year earlier and panels have gaps."""
    rows = _features(spark, sf_dir, dense=False)
    rows = rows.withColumn("tenure_months", F.col("tenure_months") - 12)
    return quality.store_checked(rows)[2]


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table's rejected rows, and how many rows are valid beside them."""
    rows = _features(spark, sf_dir, dense=False)
    rows = rows.withColumn("tenure_months", F.col("tenure_months") - 12)
    valid, rejected, _ = quality.store_checked(rows)
    return rejected.select("customer_id", _joined("violations").alias("violations")).unionByName(
        valid.agg(F.lit(None).cast("bigint").alias("customer_id"),
                  F.concat_ws(" ", F.lit("valid"), F.count(F.lit(1))).alias("violations")))


def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rows made from the customer table alone."""
    filled = quality.fill_absent(binding.customers(spark, sf_dir).drop("churn"))
    return filled.select("customer_id", *[name for name, *_ in fv.SCORING_FIELDS])


def reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select(
        "customer_id", _joined(reasons.top_reasons()).alias("top_reasons"))


def driver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model feature that the data holds, with its customers and its readable name."""
    rows = _features(spark, sf_dir)
    numeric, categorical = training.input_columns(rows)
    present = [F.when(F.col(c).isNotNull(), F.lit(f"num__{c}")) for c in numeric]
    present += [F.concat(F.lit(f"cat__{c}_"), F.col(c)) for c in categorical]
    counted = (rows.select(F.explode(F.array_compact(F.array(*present))).alias("feature"))
               .groupBy("feature").agg(F.count(F.lit(1)).alias("customers")))
    feature = F.col("feature")
    return counted.select("feature", "customers",
                          naming.display_name(feature).alias("display_name"),
                          naming.interpretation(feature).alias("interpretation"))


# ------------------------------------------------------------------------------ fitted models


@lru_cache(maxsize=4)
def _trained(app: str, spark: SparkSession, sf_dir: str) -> training.Training:
    stored = materialize(_features(spark, sf_dir), "features")
    return training.train(stored, params=RunParams(economics=COSTLY))


def _train(spark: SparkSession, sf_dir: str) -> training.Training:
    """The whole run with all candidates at their default sizes, once per application and input."""
    return _trained(spark.sparkContext.applicationId, spark, sf_dir)


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.rank_models(_train(spark, sf_dir).comparison)


def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any comparison: metrics within 0..1, the first-ranked one selected."""
    ranked = model_comparison(spark, sf_dir)
    measures = [c for c in ranked.columns if c.startswith(("cv_", "validation_"))]
    best = F.struct("cv_pr_auc_mean", "cv_recall_mean", "cv_f1_mean")
    top = ranked.agg(F.max(best).alias("top"))
    # One row: the greatest selection key.
    return ranked.join(F.broadcast(top), best == F.col("top"), "left").select(
        "model", F.forall(F.array(*measures), lambda m: (m >= 0) & (m <= 1)).alias("in_range"),
        (F.col("selected") == F.col("top").isNotNull()).alias("selection_holds"))


def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train(spark, sf_dir).report


def test_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sizes, and whether its figures agree with each other."""
    r = test_report(spark, sf_dir)
    money = (F.col("validation_gross_expected_value_inr")
             - F.col("validation_intervention_cost_inr"))
    return r.select(
        "test_size", F.round("test_churn_rate", 6).alias("test_churn_rate"),
        (F.round(F.col("validation_optimal_threshold") * 100, 6).between(5, 90)).alias("on_grid"),
        F.forall(F.array("precision", "recall", "f1", "roc_auc", "pr_auc"),
                 lambda m: (m >= 0) & (m <= 1)).alias("in_range"),
        (F.abs(F.col("validation_net_expected_value_inr") - money) < 0.01).alias("money_adds_up"))


def scored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _train(spark, sf_dir)
    answers, _ = training.score(run.data.select("customer_id", *run.artifact.features),
                                run.artifact)
    return answers.withColumn("top_reasons", _joined("top_reasons"))


def scored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons per customer, and whether the decision follows from the probability.

    Probabilities are rounded in the answers, so the decision is tested outside the last digit.
    """
    p, t = F.col("churn_probability"), F.col("decision_threshold")
    follows = F.when(F.abs(p - t) > 0.0001, F.col("high_risk") == (p >= t)).otherwise(True)
    return scored_customers(spark, sf_dir).select(
        "customer_id", "top_reasons", (follows & p.between(0, 1)).alias("decision_holds"))


def logistic_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised loss has no slope at the weights of any fit: set, feature, slope per row."""
    data = _split_features(spark, sf_dir)
    numeric, categorical = training.input_columns(data)
    sets = training.fit_sets(fv.CV_FOLDS)
    learned = preprocess.fit(data, numeric, categorical, sets)
    fitted = models.fit(models.logistic_regression(), learned, data, sets)
    slopes = []
    for name, parts in sets.items():
        p, model = learned[name], fitted[name]
        w0, w1 = models.balanced_weights(p)
        weight = F.when(F.col("churn") == 1, w1).otherwise(w0)
        scored = model.transform(data.filter(preprocess.in_parts(parts))).select(
            (weight * (vector_to_array("probability")[1] - F.col("churn"))).alias("e"),
            vector_to_array("features").alias("x"))
        sums = scored.agg(*[F.sum(F.col("e") * F.get("x", F.lit(i))).alias(f"g{i}")
                            for i in range(len(p.feature_names))])
        weights = model.stages[-1].coefficients.toArray().tolist()
        pairs = [F.struct(F.lit(n).alias("feature"),
                          (F.round((F.col(f"g{i}") + weights[i]) / p.rows, 6) + F.lit(0.0))
                          .alias("gradient")) for i, n in enumerate(p.feature_names)]
        slopes.append(sums.select(F.lit(name).alias("fit_set"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, slopes)


def model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored model says of itself after loading."""
    artifact = _train(spark, sf_dir).artifact
    path = new_path(spark, "model")
    artifacts.save(artifact, spark, path)
    return artifacts.load(spark, path).metadata(spark).select(
        F.lit("ok").alias("status"), F.col("model_name").alias("model"), "model_version",
        "decision_threshold")


def identity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded model is the run's: same name, version and threshold."""
    run = _train(spark, sf_dir)
    return model_identity(spark, sf_dir).select(
        "status", (F.col("model") == run.artifact.model_name).alias("same_model"),
        (F.col("model_version") == run.artifact.model_version).alias("same_version"),
        (F.col("decision_threshold") == run.artifact.decision_threshold).alias("same_threshold"))


def driver_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's drivers over all rows as the nested report, unnested again."""
    run = _train(spark, sf_dir)
    if training.is_linear(run.artifact):
        importance = training.attributions(run.artifact, run.data)
    else:
        importance = training.tree_importances(run.artifact, spark).withColumnRenamed(
            "importance", "mean_abs_shap")
    nested = reports.driver_report(importance, run.artifact.model_name,
                                   F.lit(run.artifact.model_version))
    return nested.select("model_name", "method", "top_n", F.inline("drivers"))


def driver_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten drivers, all of them model features with a name, strongest first."""
    rows = driver_report(spark, sf_dir)
    features = _train(spark, sf_dir).artifact.feature_names
    return rows.agg(
        F.count("*").alias("drivers"), F.max("top_n").cast("long").alias("top_n"),
        F.bool_and(F.col("feature").isin(*features) & (F.col("display_name") != ""))
        .alias("named"), F.bool_and(F.col("mean_abs_shap") >= 0).alias("not_negative"))


QUERIES: dict[str, Query] = {
    "feature_table": feature_table,
    "bucketed_features": bucketed_features,
    "incremental_features": incremental_features,
    "feature_view": feature_view,
    "io_roundtrip": io_roundtrip,
    "lag_usage": lag_usage,
    "rolling_usage": partial(_rolling, "rolling_3m_data_gb"),
    "rolling_recency": partial(_rolling, "rolling_3m_recharge_recency"),
    "event_windows": event_windows,
    "customer_usage_agg": lambda s, d: _behaviour(panel.usage_levels(), s, d),
    "recharge_frequency": lambda s, d: _behaviour((panel.recharge_frequency(),), s, d),
    "usage_increase": lambda s, d: _behaviour((panel.usage_increase_months(),), s, d),
    "monthly_delta": lambda s, d: _behaviour((panel.avg_monthly_data_delta(),), s, d, False),
    "rolling_agg": lambda s, d: _behaviour(panel.rolling_levels(), s, d),
    "usage_trend": lambda s, d: _behaviour((panel.usage_trend(),), s, d),
    "usage_union": usage_union,
    "usage_left_join": usage_left_join,
    "attribute_merge": attribute_merge,
    "plan_price_lookup": plan_price_lookup,
    "clamped_usage": clamped_usage,
    "clamped_customers": clamped_customers,
    "city_tier": city_tier,
    "tenure_bucket": tenure_bucket,
    "not_null_violations": not_null_violations,
    "not_null_orders": not_null_orders,
    "order_key_duplicates": order_key_duplicates,
    "pk_duplicates": pk_duplicates,
    "usage_key_duplicates": usage_key_duplicates,
    "churn_by_plan": churn_by_plan,
    "churn_by_tenure": churn_by_tenure,
    "churn_distribution": churn_distribution,
    "profile_scalars": profile_scalars,
    "profile_scalars_orders": profile_scalars_orders,
    "numeric_profile": numeric_profile,
    "eda_summary": eda_summary,
    "scorecard": scorecard,
    "scorecard_decisions": scorecard_decisions,
    "roi_curve_histogram": roi_curve_histogram,
    "roi_best": roi_best,
    "roi_by_plan": roi_by_plan,
    "roi_report": roi_report,
    "threshold_metrics": threshold_metrics,
    "roc_auc": partial(_ranking, "roc_auc"),
    "average_precision": partial(_ranking, "pr_auc"),
    "scorecard_report": scorecard_report,
    "headline_numbers": headline_numbers,
    "scorecard_attribution": scorecard_attribution,
    "split_assignment": split_assignment,
    "fold_assignment": fold_assignment,
    "class_weights": class_weights,
    "impute_fit": impute_fit,
    "standardize": standardize,
    "one_hot": one_hot,
    "validate_inputs": validate_inputs,
    "rule_violations": rule_violations,
    "rejected_rows": rejected_rows,
    "default_fill": default_fill,
    "reasons": reason_texts,
    "driver_names": driver_names,
    "standardize_constant": standardize_constant,
    "logistic_gradient": logistic_gradient,
    "model_comparison": model_comparison,
    "model_facts": model_facts,
    "test_report": test_report,
    "test_facts": test_facts,
    "scored_customers": scored_customers,
    "scored_facts": scored_facts,
    "model_identity": model_identity,
    "identity_facts": identity_facts,
    "driver_report": driver_report,
    "driver_facts": driver_facts,
}
