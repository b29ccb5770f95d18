"""Threshold curves and the best threshold."""

import random

import pytest
from pyspark.sql import functions as F

from tenura.operators import economics
from tenura.schema import Economics

ROWS = [(0, 0.1), (1, 0.8), (0, 0.3), (1, 0.9)]
MONEY = Economics(300.0, 80.0, 0.35)


@pytest.fixture(params=["histogram", "direct"])
def curve_of(request):
    return {"histogram": economics.threshold_curve,
            "direct": economics.threshold_curve_direct}[request.param]


def test_worked_curve(spark, curve_of):
    df = spark.createDataFrame(ROWS, "churn int, p double")
    curve = curve_of(df, (0.5, 0.8), MONEY)
    assert tuple(curve.columns) == economics.CURVE_COLUMNS
    rows = sorted(map(tuple, curve.collect()))
    assert rows == [(t, 2, 0.5, 2, 1.0, 1.0, pytest.approx(210.0), 160.0, pytest.approx(50.0))
                    for t in (0.5, 0.8)]
    best = economics.best_threshold(curve).first()
    assert best["threshold"] == 0.5 and best.asDict().keys() == set(economics.CURVE_COLUMNS)


def test_empty_input_gives_zeros(spark, curve_of):
    df = spark.createDataFrame([], "churn int, p double")
    rows = curve_of(df, (0.2, 0.5), MONEY).collect()
    assert len(rows) == 2
    assert all(v == 0 for r in rows for k, v in r.asDict().items() if k != "threshold")


def test_missing_scores_are_never_targeted(spark, curve_of):
    df = spark.createDataFrame([(1, float("nan")), (0, None), (1, 0.6)], "churn int, p double")
    row = curve_of(df, (0.5,), MONEY).first()
    assert (row["targeted_customers"], row["captured_churners"]) == (1, 1)
    assert row["targeted_share"] == pytest.approx(1 / 3) and row["recall"] == 0.5


def test_curves_agree_and_fall(spark):
    rnd = random.Random(1)
    rows = [(int(rnd.random() < 0.4), rnd.choice([round(rnd.random(), 2), rnd.random()]))
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "churn int, p double").repartition(7)
    a = [tuple(r) for r in economics.threshold_curve(df).orderBy("threshold").collect()]
    b = [tuple(r) for r in economics.threshold_curve_direct(df).orderBy("threshold").collect()]
    assert a == b and len(a) == 86
    for before, after in zip(a, a[1:]):
        assert after[1] <= before[1] and after[3] <= before[3]
    for r in a:
        t = r[0]
        assert r[1] == sum(p >= t for _, p in rows)
        assert r[3] == sum(y for y, p in rows if p >= t)
        assert r[8] == pytest.approx(r[6] - r[7])
        assert all(0 <= r[i] <= 1 for i in (2, 4, 5))


def test_groups_and_unsorted_thresholds(spark):
    df = spark.createDataFrame([("a", *r) for r in ROWS] + [("b", 1, 0.2)],
                               "model string, churn int, p double")
    curve = economics.threshold_curve(df, (0.8, 0.15), MONEY, by=("model",))
    got = {(r["model"], r["threshold"]): (r["targeted_customers"], r["captured_churners"])
           for r in curve.collect()}
    assert got == {("a", 0.15): (3, 2), ("a", 0.8): (2, 2), ("b", 0.15): (1, 1), ("b", 0.8): (0, 0)}
    best = {r["model"]: r["threshold"]
            for r in economics.best_threshold(curve, ("model",)).collect()}
    assert best == {"a": 0.8, "b": 0.15}


def test_best_skips_nan(spark):
    df = spark.createDataFrame([(0.1, float("nan")), (0.2, 1.0), (0.3, 1.0)],
                               "threshold double, net_expected_value_inr double")
    assert economics.best_threshold(df).first()["threshold"] == 0.2


def test_known_optima(spark, medium):
    from tenura.plans import catalog
    scored = catalog._scores(spark, medium).select("churn", "p").cache()
    expected = {30.0: (0.05, 1306, 539, 17415.0), 45.0: (0.72, 160, 72, 360.0),
                80.0: (0.90, 22, 6, -1130.0)}
    for cost, (threshold, targeted, captured, net) in expected.items():
        curve = economics.threshold_curve(scored, money=Economics(intervention_cost=cost))
        best = economics.best_threshold(curve).first()
        assert (best["threshold"], best["targeted_customers"],
                best["captured_churners"]) == (threshold, targeted, captured)
        assert best["net_expected_value_inr"] == pytest.approx(net)
    hits = scored.filter(F.col("p") >= 0.5).agg(F.sum("churn"), F.count("*")).first()
    assert (hits[0], hits[1] - hits[0]) == (171, 235)
    scored.unpersist()
