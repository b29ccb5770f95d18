"""Column functions, names and reasons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.functions import naming, reasons, scalars
from tenura.operators import panel


def column(spark, values, kind, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_city_tier(spark):
    cities = ["Mumbai", "Pune", "Jaipur", "Indore", "Patna", "Elsewhere", None]
    assert column(spark, cities, "string", scalars.city_tier) == [1, 1, 2, 2, 3, 3, 3]


def test_tenure_bucket(spark):
    months = [6, 7, 12, 13, 24, 25, 48, 49, 73, None]
    assert column(spark, months, "int", scalars.tenure_bucket) == [
        "0-6", "7-12", "7-12", "13-24", "13-24", "25-48", "25-48", "49-72", "49-72", "49-72"]


def test_tenure_interval_drops_what_lies_outside(spark):
    months = [0, 6, 7, 48, 72, 73, -1, None]
    assert column(spark, months, "int", scalars.tenure_interval) == [
        "[0, 6]", "[0, 6]", "(6, 12]", "(24, 48]", "(48, 72]", None, None, None]


def test_clamp_keeps_null(spark):
    assert column(spark, [-1.0, 3.0, 99.0, None], "double",
                  lambda c: scalars.clamp(c, 0.1, 45.0)) == [0.1, 3.0, 45.0, None]


def test_clamped_usage(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.0, -3, 60.0, 10.0)],
        "customer_id long, month_index int, data_gb double, calls_count int, "
        "days_since_recharge double, recharge_amount_inr double")
    assert tuple(panel.clamped(df).first()) == (1, 1, 0.2, 0, 45.0, 99.0)
    assert panel.clamped(df).schema == df.schema


def test_at_or_above_is_inclusive_and_rejects_nan(spark):
    scores = [0.5, 0.49999, float("nan"), None]
    assert column(spark, scores, "double", lambda c: scalars.at_or_above(c, 0.5)) == [
        True, False, False, False]


def test_grid_equals_numpy():
    expected = np.round(np.arange(0.05, 0.90 + 1e-9, 0.01), 2)
    grid = scalars.threshold_grid(0.05, 0.90, 0.01)
    assert len(grid) == 86 and grid == list(expected)


def test_scorecard_value(spark):
    row = dict(avg_days_since_recharge=16.0, tenure_months=10, support_tickets=4, avg_data_gb=4.0,
               data_usage_trend=-0.2, autopay_type="Card Autopay", contract_type="Quarterly",
               city="Patna", plan_name="Hotstar Mobile")
    df = spark.createDataFrame([row])
    logit = (-1.45 + .055 * 16 - .02 * 10 - .15 + .22 * 4 - .035 * 4 + .45 * .2 + .35 + .12 + .15)
    got = df.select(scalars.scorecard_logit().alias("z"),
                    scalars.sigmoid(scalars.scorecard_logit()).alias("p")).first()
    assert got["z"] == pytest.approx(logit)
    assert got["p"] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_plan_price(spark):
    plans = ["Jio 299", "Hotstar Mobile", "unknown", None]
    assert column(spark, plans, "string", scalars.plan_price) == [299, 149, None, None]


def test_count_at_or_below(spark):
    bounds = [0.1, 0.2, 0.2, 0.5]
    grid, size = scalars.padded(bounds)
    xs = [0.0, 0.1, 0.15, 0.2, 0.3, 0.5, 9.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = scalars.with_count_at_or_below(df, "x", grid, size, "n").orderBy("i").collect()
    assert [r["n"] for r in got] == [int(np.searchsorted(bounds, x, "right")) for x in xs]
    with pytest.raises(ValueError):
        scalars.with_count_at_or_below(df, "x", grid, 4, "n")


def test_names(spark):
    cases = {
        "num__support_tickets": "Support tickets",
        "num__city_tier": "City Tier",
        "cat__contract_type_Monthly": "Contract: Monthly",
        "cat__autopay_type_UPI Autopay": "Payment: UPI Autopay",
        "cat__plan_name_a_b": "Plan: a b",
        "cat__tenure_bucket_0-6": "Tenure Bucket 0-6",
        "cat__city_new delhi 3m": "City New Delhi 3M",
    }
    assert column(spark, list(cases), "string", naming.display_name) == list(cases.values())
    texts = column(spark, list(cases), "string", naming.interpretation)
    assert texts[0].startswith("Support-ticket") and texts[1] == fv.FEATURE_FALLBACK


def test_title_case_matches_python(spark):
    words = ["abc def", "o'neil x-ray", "3rd UPPER", "a1b2", "", "élan vital"]
    assert column(spark, words, "string", naming.title_case) == [w.title() for w in words]


def reasons_of(spark, **changes):
    row = dict(avg_days_since_recharge=8.0, support_tickets=1, avg_monthly_data_delta=0.1,
               contract_type="Annual", autopay_type="UPI Autopay")
    return spark.createDataFrame([{**row, **changes}]).select(reasons.top_reasons()).first()[0]


def test_reasons(spark):
    assert reasons_of(spark) == [fv.REASON_FALLBACK]
    assert reasons_of(
        spark, avg_days_since_recharge=16.0, support_tickets=4, avg_monthly_data_delta=-0.6,
        contract_type="Monthly", autopay_type="Manual Recharge",
    ) == [fv.REASON_RECHARGE, fv.REASON_SUPPORT, fv.REASON_USAGE]
    assert reasons_of(spark, avg_days_since_recharge=10.0, support_tickets=3,
                      avg_monthly_data_delta=-0.2) == [fv.REASON_SUPPORT]
    assert reasons_of(spark, autopay_type="Manual Recharge", contract_type="Monthly") == [
        fv.REASON_CONTRACT, fv.REASON_PAYMENT]
