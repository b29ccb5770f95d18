"""Windows and behaviour features on worked panels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tenura.operators import panel
from tenura.plans import features
from tenura.sources import binding, sinks

A_DATA, A_DAYS = (10, 12, 11, 15, 15, 18), (5, 9, 12, 10, 20, 3)
WORKED = {
    "A": dict(avg_data_gb=13.5, avg_days_since_recharge=9.833333, max_days_since_recharge=20.0,
              recharge_frequency=4, avg_rolling_3m_data_gb=12.388889, usage_increase_months=3,
              avg_monthly_data_delta=1.333333, max_rolling_recharge_recency=14.0,
              data_usage_trend=1.514286),
    "B": dict(avg_data_gb=8.0, avg_days_since_recharge=10.5, max_days_since_recharge=11.0,
              recharge_frequency=1, avg_rolling_3m_data_gb=7.5, usage_increase_months=1,
              avg_monthly_data_delta=2.0, max_rolling_recharge_recency=11.0,
              data_usage_trend=2.0),
}


@pytest.fixture(scope="module")
def worked(spark):
    rows = [(1, m + 1, float(A_DATA[m]), 100, float(A_DAYS[m]), 99.0) for m in range(6)]
    rows += [(2, 3, 7.0, 50, 11.0, 99.0), (2, 4, 9.0, 51, 10.0, 99.0)]
    usage = spark.createDataFrame(
        rows, "customer_id long, month_index int, data_gb double, calls_count int, "
              "days_since_recharge double, recharge_amount_inr double")
    customers = spark.createDataFrame(
        [(k, "Indore", "Jio 299", "UPI Autopay", 10, 1, "Monthly", 6.0, 0) for k in (1, 2, 3)],
        "customer_id long, city string, plan_name string, autopay_type string, "
        "tenure_months int, support_tickets int, contract_type string, data_cap_gb double, "
        "churn int")
    return customers, usage


@pytest.mark.parametrize("bounded", [True, False])
def test_worked_customers(worked, bounded):
    customers, usage = worked
    rows = features.feature_table(customers, usage, trend=True, bounded=bounded).collect()
    by_id = {r["customer_id"]: r for r in rows}
    assert set(by_id) == {1, 2}
    for key, name in ((1, "A"), (2, "B")):
        for column, value in WORKED[name].items():
            assert by_id[key][column] == pytest.approx(value, abs=1e-6), (name, column)


def test_feature_columns(worked):
    table = features.feature_table(*worked)
    assert tuple(table.columns) == features.FEATURE_COLUMNS
    types = dict(table.dtypes)
    assert types["city_tier"] == "int" and types["recharge_frequency"] == "bigint"
    assert types["usage_increase_months"] == "bigint" and types["avg_calls"] == "double"


def test_missing_measures(spark):
    usage = spark.createDataFrame(
        [(1, 1, 5.0, 1, None, 1.0), (1, 2, None, 1, 3.0, 1.0), (1, 3, 7.0, 1, 4.0, 1.0)],
        "customer_id long, month_index int, data_gb double, calls_count int, "
        "days_since_recharge double, recharge_amount_inr double")
    row = panel.customer_behaviour(usage).first()
    assert row["recharge_frequency"] == 2
    assert row["usage_increase_months"] == 0
    assert row["avg_monthly_data_delta"] == 0.0
    assert row["avg_data_gb"] == 6.0


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most of the rows, one without a name, many small ones."""
    rnd = random.Random(7)
    rows = [(0, i, rnd.random()) for i in rnd.sample(range(-500, 5000), 900)]
    rows += [(None, i, rnd.random()) for i in range(20)] + [(5, None, 0.5)]
    for key in range(1, 40):
        rows += [(key, i, rnd.random()) for i in rnd.sample(range(0, 3000), rnd.randint(1, 9))]
    return spark.createDataFrame(rows, "k int, i int, v double").repartition(7)


@pytest.mark.parametrize("pieces", [None, 1, 2, 7, 64, 5000])
def test_windows_over_ranges_equal_plain_ones(hot, pieces):
    plain = panel.with_windows(hot, "k", "i", "v", None, bounded=True)
    names = sorted(plain.columns)
    expected = sorted(map(tuple, plain.select(names).collect()), key=str)
    ranged = panel.with_windows(hot, "k", "i", "v", None, pieces=pieces)
    assert ranged.columns == plain.columns
    got = sorted(map(tuple, ranged.select(names).collect()), key=str)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for g, e in zip(got, expected):
        assert g[3:] == pytest.approx(e[3:])


def test_a_hot_key_is_spread_over_ranges(hot):
    sizes = [r["count"] for r in panel._with_ranges(hot, "k", "i", 16).groupBy("_range").count()
             .collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16


def test_windows_of_repeated_places_and_other_types(spark):
    same = spark.createDataFrame([("a", "x", 1.0)] * 50 + [("b", "y", 2.0)], "k string, i string, v double")
    out = panel.with_windows(same, "k", "i", "v", None, pieces=8).collect()
    assert sorted(r["prev_data_gb"] or 0.0 for r in out) == [0.0] * 2 + [1.0] * 49
    assert panel.with_windows(same.limit(0), "k", "i", "v", None).collect() == []


def test_the_rows_are_shuffled_once(hot):
    df = panel.with_windows(hot.select("k", "i", "v"), "k", "i", "v", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(k", plan)) == 1


def test_rolling_mean_lies_in_its_frame(spark, small):
    w = panel.with_windows(binding.usage(spark, small), bounded=True)
    assert w.filter(F.col("rolling_3m_data_gb") < 0).count() == 0
    dense = panel.customer_behaviour(binding.usage(spark, small))
    ends = (binding.usage(spark, small).groupBy("customer_id")
            .agg(F.max_by("data_gb", "month_index").alias("last"),
                 F.min_by("data_gb", "month_index").alias("first")))
    off = dense.join(ends, "customer_id").filter(
        F.abs(F.col("avg_monthly_data_delta") - (F.col("last") - F.col("first")) / 6) > 1e-9)
    assert off.count() == 0


def test_plan_has_one_window_and_one_exchange_per_side(spark, tmp_path, small):
    binding.customers(spark, small).write.parquet(str(tmp_path / "customers"))
    binding.usage(spark, small).write.parquet(str(tmp_path / "usage"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = features.feature_table(spark.read.parquet(str(tmp_path / "customers")),
                                       spark.read.parquet(str(tmp_path / "usage")), trend=True)
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert len(re.findall(r"[ -] ?Window \[", plan)) == 1
    assert "EvalPython" not in plan


def test_stored_pair_needs_no_exchange(spark, tmp_path, small):
    """Windows, aggregate and join run on the buckets; rows equal those of the plain tables."""
    customers, usage = binding.customers(spark, small), binding.usage(spark, small)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sinks.write_bucketed(customers, "kept_customers", str(tmp_path / "c"), "customer_id",
                                    buckets=4)
        months = sinks.write_bucketed(usage, "kept_usage", str(tmp_path / "u"), "customer_id",
                                      ("month_index",), buckets=4)
        table = features.feature_table(kept, months, trend=True)
        plan = table._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, table.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    files = [f for f in (tmp_path / "u").iterdir() if f.suffix == ".parquet"]
    assert len(files) == 4
    expected = sorted(map(tuple, features.feature_table(customers, usage, trend=True).collect()))
    assert [g[:6] for g in got] == [e[:6] for e in expected]
    for g, e in zip(got, expected):
        assert [v for v in g if isinstance(v, float)] == pytest.approx(
            [v for v in e if isinstance(v, float)])
    again = sinks.write_bucketed(customers.limit(3), "kept_customers", str(tmp_path / "c2"),
                                 "customer_id", buckets=2)
    assert again.count() == 3
    for name in ("kept_customers", "kept_usage"):
        spark.sql(f"DROP TABLE {name}")


def test_binding_counts(spark, small, medium):
    expected = {small: (150, 900, 0.433333, 275, 355), medium: (1500, 9000, 0.41, 2648, 3563)}
    for folder, (customers, rows, churn, recharges, increases) in expected.items():
        usage = binding.usage(spark, folder)
        assert usage.count() == rows
        table = features.feature_table(binding.customers(spark, folder), usage)
        r = table.agg(F.count("*"), F.avg("churn"), F.sum("recharge_frequency"),
                      F.sum("usage_increase_months")).first()
        assert (r[0], r[2], r[3]) == (customers, recharges, increases)
        assert r[1] == pytest.approx(churn, abs=1e-6)


def test_large_order_values(spark):
    first = 2**60 + 1
    rows = [(1, first + i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = panel.with_windows(df, "k", "i", "v", None, pieces=13).orderBy("i").collect()
    assert [r["prev_data_gb"] for r in got] == [None, *[float(i) for i in range(39)]]
