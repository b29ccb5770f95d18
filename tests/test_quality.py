"""Integrity rules, table facts and scoring-row validation."""

import pytest
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.operators import profile, quality
from tenura.sources import sinks, tables

GOOD = {name: default for name, _, default, _, _ in fv.SCORING_FIELDS}
TYPES = ", ".join(f"{name} {kind}" for name, kind, *_ in fv.SCORING_FIELDS)


def violations(spark, schema=TYPES, **changes):
    row = {**GOOD, **changes}
    df = spark.createDataFrame([tuple(row[n] for n, *_ in fv.SCORING_FIELDS)], schema)
    return quality.with_violations(df).first()["violations"]


def test_good_row(spark):
    assert violations(spark) == []
    assert violations(spark, avg_monthly_data_delta=-50.0, tenure_months=1, data_cap_gb=0.0) == []


@pytest.mark.parametrize("changes,expected", [
    ({"city_tier": 9}, ["city_tier:range"]),
    ({"city_tier": 0}, ["city_tier:range"]),
    ({"tenure_months": 0}, ["tenure_months:range"]),
    ({"support_tickets": -1, "avg_calls": -0.5}, ["support_tickets:range", "avg_calls:range"]),
    ({"avg_data_gb": None}, ["avg_data_gb:missing"]),
    ({"avg_data_gb": float("nan")}, ["avg_data_gb:range"]),
    ({"city": None}, ["city:missing"]),
])
def test_broken_rows(spark, changes, expected):
    assert violations(spark, **changes) == expected


def test_types(spark):
    loose = TYPES.replace("tenure_months int", "tenure_months double").replace(
        "avg_calls double", "avg_calls string")
    assert violations(spark, loose, tenure_months=10.0, avg_calls="3") == []
    assert violations(spark, loose, tenure_months=10.5, avg_calls="many") == [
        "tenure_months:type", "avg_calls:type"]


def test_split_and_fill(spark):
    rows = spark.createDataFrame([(1, 9), (2, 2)], "customer_id long, city_tier int")
    valid, rejected = quality.split_valid(quality.fill_absent(rows))
    good = valid.first()
    assert good["customer_id"] == 2 and good["city"] == "Indore" and good["avg_calls"] == 200.0
    assert rejected.select("customer_id", "violations").collect() == [(1, ["city_tier:range"])]
    null = quality.fill_absent(spark.createDataFrame([(1, None)], "customer_id long, city string"))
    assert quality.with_violations(null).first()["violations"] == ["city:missing"]


def test_checked_once(spark):
    """Both sides and the counts come from one job and agree with the two-filter form."""
    rows = [(i, [1, 9, None][i % 3], [5, 0][i % 2], float(i) if i % 5 else float("nan"))
            for i in range(60)]
    df = quality.fill_absent(spark.createDataFrame(
        rows, "customer_id long, city_tier int, tenure_months long, avg_calls double").repartition(4))
    valid, rejected, counts = quality.store_checked(df)
    plain, refused = quality.split_valid(df)
    assert valid.dtypes == plain.dtypes and rejected.columns == refused.columns
    assert sorted(valid.collect()) == sorted(plain.collect()) != []
    assert (sorted(rejected.select("customer_id", "violations").collect())
            == sorted(refused.select("customer_id", "violations").collect()))
    expected = {rule: 0 for rule in quality.rule_names()}
    for r in refused.collect():
        for rule in r["violations"]:
            expected[rule] += 1
    assert {r["rule"]: r["rows"] for r in counts.collect()} == expected
    assert expected["city_tier:missing"] == expected["city_tier:range"] == 20
    read = rejected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_valid" in read


def test_checking_reads_the_rows_once(spark):
    source = spark.range(300).repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = source.mapInArrow(note, "id long").selectExpr("id AS customer_id",
                                                       "CAST(id % 4 AS INT) AS city_tier")
    valid, rejected, counts = quality.store_checked(quality.fill_absent(df))
    assert (valid.count(), rejected.count()) == (225, 75)
    assert counts.filter("rows > 0").collect() == [("city_tier:range", 75)]
    assert seen.value == 300


def test_nothing_to_check(spark):
    empty = quality.fill_absent(spark.createDataFrame([], "customer_id long"))
    valid, rejected, counts = quality.store_checked(empty)
    assert valid.count() == rejected.count() == 0
    assert {r["rows"] for r in counts.collect()} == {0}


def test_rules_on_tables(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 1, None), (1, 2, "b"), (None, 1, "c"), (None, 3, None)],
        "k long, m int, s string")
    nulls = {r["column_name"]: r["violations"]
             for r in quality.not_null_violations(df, ("k", "m", "s"), "t").collect()}
    assert nulls == {"k": 2, "m": 0, "s": 2}
    assert [tuple(r) for r in quality.duplicate_keys(df, ("k", "m")).collect()] == [(1, 1, 2)]


def test_table_facts(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0), (1, 1, float("nan")), (None, 1, None), (None, 0, 2.0), (2, 1, 3.0)],
        "k long, churn int, x double")
    row = quality.table_facts(df, "k", "churn").first()
    assert tuple(row) == (5, 3, 0.6, 4, 2)


def test_profiles(spark):
    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 0, 73), ("b", 1, 12), (None, 1, 72)],
        "plan_name string, churn int, tenure_months int")
    assert [tuple(r) for r in profile.churn_rate_by(df, "plan_name").collect()] == [
        ("b", 1.0), ("a", 0.5)]
    assert {tuple(r) for r in profile.churn_rate_by_tenure(df).collect()} == {
        ("[0, 6]", 1.0), ("(6, 12]", 1.0), ("(48, 72]", 1.0)}
    ones = df.filter(F.col("churn") == 1)
    assert sorted(map(tuple, profile.class_distribution(ones).collect())) == [(0, 0), (1, 3)]


def test_csv_is_read_under_the_declared_schema(spark, tmp_path):
    good = tmp_path / "usage.csv"
    good.write_text("month_index,customer_id,data_gb,calls_count,days_since_recharge,"
                    "recharge_amount_inr\n1,7,2.5,3,4.5,99\n")
    assert tuple(tables.read_usage(spark, str(good)).first()) == (7, 1, 2.5, 3, 4.5, 99.0)
    bad = tmp_path / "bad.csv"
    bad.write_text(good.read_text().replace("2.5", "much"))
    with pytest.raises(Exception):
        tables.read_usage(spark, str(bad)).collect()
    short = tmp_path / "short.csv"
    short.write_text("customer_id\n1\n")
    with pytest.raises(ValueError):
        tables.read_usage(spark, str(short))


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        sinks.write_table(df, path)
        assert tuple(tables.read_report(spark, path, df.schema).first()) == (1, "x", None)
    nested = df.select(F.struct("a", "b", "c").alias("s"))
    path = str(tmp_path / "n.json")
    sinks.write_document(nested, path)
    assert tables.read_report(spark, path, nested.schema).first() == nested.first()
