"""Exact order statistics and ranking metrics against brute force."""

import math
import random
import struct

import numpy as np
import pytest

from tenura.operators import metrics, ordering, profile


def brute_auc(y, p):
    pos = [s for s, t in zip(p, y) if t]
    neg = [s for s, t in zip(p, y) if not t]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return won / (len(pos) * len(neg))


def brute_ap(y, p):
    total, last, area = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [label for label, s in zip(y, p) if s >= t]
        recall = sum(hit) / total
        area += (recall - last) * sum(hit) / len(hit)
        last = recall
    return area


@pytest.fixture(scope="module")
def scored():
    """Per model: continuous scores, few distinct scores, and one score held by a third of rows."""
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        y = int(rnd.random() < 0.3)
        rows.append(("smooth", y, min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2)))))
        rows.append(("coarse", y, round(rnd.random(), 1)))
        rows.append(("hot", y, 0.25 if i % 3 == 0 else rnd.random() ** 8))
    return rows


def test_ranking_metrics(spark, scored):
    df = spark.createDataFrame(scored, "model string, churn int, p double").repartition(5)
    got = {r["model"]: r for r in metrics.ranking_metrics(df, ["model"]).collect()}
    assert set(got) == {"smooth", "coarse", "hot"}
    for model, row in got.items():
        y = [r[1] for r in scored if r[0] == model]
        p = [r[2] for r in scored if r[0] == model]
        assert row["roc_auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
        assert row["pr_auc"] == pytest.approx(brute_ap(y, p), abs=1e-12)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_rows_without_a_score_are_refused(spark, bad):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 0, bad)], "model string, churn int, p double")
    with pytest.raises(ValueError, match="1 rows have no score"):
        metrics.ranking_metrics(df, ["model"])


def test_ranking_metrics_of_one_class(spark):
    df = spark.createDataFrame([("m", 0, 0.2), ("m", 0, 0.4)], "model string, churn int, p double")
    row = metrics.ranking_metrics(df, ["model"]).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0


def test_published_confusion_arithmetic(spark):
    rows = [(1, 0.9)] * 143 + [(0, 0.9)] * 246 + [(1, 0.1)] * 138 + [(0, 0.1)] * 673
    row = metrics.threshold_metrics(
        spark.createDataFrame(rows, "churn int, p double"), 0.57).first()
    assert (row["size"], row["tp"], row["fp"], row["fn"]) == (1200, 143, 246, 138)
    assert row["churn_rate"] == pytest.approx(0.2341666667)
    assert row["precision"] == pytest.approx(0.3676092545)
    assert row["recall"] == pytest.approx(0.5088967972)
    assert row["f1"] == pytest.approx(0.4268656716)


def test_threshold_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "churn int, p double")
    row = metrics.threshold_metrics(empty).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_ordered_prefix(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([1.0, 2.0, rnd.random() * 3])) for g in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    for descending in (False, True):
        got = ordering.ordered_prefix(df, ["g"], "v", {"n": "1"}, descending).collect()
        for r in got:
            vs = [v for g, v in rows if g == r["g"]]
            before = sum(v > r["v"] if descending else v < r["v"] for v in vs)
            assert (r["n"], r["before_n"], r["total_n"]) == (vs.count(r["v"]), before, 400)


def test_exact_quantiles_of_overlapping_subsets(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        rows.append(("x", i % 3, rnd.gauss(0, 1)))
        rows.append(("y", i % 3, 7.0 if i % 3 == 0 else float(rnd.randint(0, 4))))
    rows += [("x", 0, None), ("y", 1, float("nan")), ("one", 2, 5.0)]
    df = spark.createDataFrame(rows, "f string, part int, v double").repartition(6)
    sets = {"all": "1", "not0": "CAST(part <> 0 AS INT)", "only1": "CAST(part = 1 AS INT)"}
    keep = {"all": {0, 1, 2}, "not0": {1, 2}, "only1": {1}}
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["f"], r["weight"], r["prob"]): r["quantile"]
           for r in ordering.exact_quantiles(df, ["f"], "v", probs, sets).collect()}
    for f in ("x", "y"):
        for name, parts in keep.items():
            values = [v for g, p, v in rows
                      if g == f and p in parts and v is not None and v == v]
            for prob in probs:
                assert got[f, name, prob] == pytest.approx(np.quantile(values, prob))
    assert got["one", "all", 0.5] == 5.0 and got["one", "only1", 0.5] is None


def bits_of(value):
    bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
    return -bits if value < 0 else bits


def test_ordered_bits(spark):
    rnd = random.Random(13)
    edge = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
            float("inf"), 0.1, 1.0, 3.0]
    edge += [np.nextafter(2.0 ** e, side) for e in (-1074, -1022, -30, 0, 1, 52, 53, 1000, 1023)
             for side in (0.0, float("inf"))] + [2.0 ** e for e in range(-1074, 1024)]
    values = [float(v) for v in edge] + [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(4000)]
    values = [v for v in values if v == v]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.selectExpr("v", f"{ordering.ordered_bits('v')} AS b").collect()
    assert [r["b"] for r in got] == [bits_of(r["v"]) for r in got]
    assert spark.sql(f"SELECT {ordering.ordered_bits('double(\'NaN\')')} AS b").first()["b"] is None
    assert all(ordering._from_bits(bits_of(v)) == v for v in values)


def test_counted_quantiles_of_overlapping_subsets(spark):
    rnd = random.Random(17)
    rows = [(i % 3, rnd.gauss(0, 1), 7.0 if i % 3 == 0 else float(rnd.randint(-4, 4)),
             rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300), rnd.randint(-9, 9), None)
            for i in range(900)]
    rows += [(0, None, float("nan"), float("inf"), None, None)]
    rows += [(3, 5.0, -0.0, float("-inf"), 2, None), (None, 1.0, 1.0, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "part int, a double, b double, c double, d int, e double")
    sets = {"all": "1", "not0": "CAST(coalesce(part <> 0, false) AS INT)",
            "only3": "CAST(coalesce(part = 3, false) AS INT)",
            "none": "CAST(coalesce(part = 9, false) AS INT)"}
    keep = {"all": {0, 1, 2, 3, None}, "not0": {1, 2, 3}, "only3": {3}}
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = ordering.counted_quantiles(df.repartition(5), ["a", "b", "c", "d", "e"], probs, sets)
    expected = {}
    for k, column in enumerate("abcd", start=1):
        for name, parts in keep.items():
            values = sorted(r[k] for r in rows if r[0] in parts and r[k] is not None and r[k] == r[k])
            for p in probs:
                at = (len(values) - 1) * p
                low, high = values[math.floor(at)], values[math.ceil(at)]
                expected[column, name, p] = (
                    low if low == high else low + (high - low) * (at - math.floor(at)))
    assert got.keys() == expected.keys()
    assert all(got[k] == expected[k] or got[k] == pytest.approx(expected[k], rel=1e-15) for k in got)
    assert ordering.counted_quantiles(df.limit(0), ["a"], (0.5,)) == {}
    assert ordering.counted_quantiles(df, [], (0.5,)) == {}


def test_counting_takes_few_jobs(spark):
    rnd = random.Random(19)
    df = spark.createDataFrame([(rnd.lognormvariate(0, 9), rnd.random()) for _ in range(5000)],
                               "a double, b double").repartition(4)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counting", "counting")
    try:
        found = ordering.counted_quantiles(df, ["a", "b"], (0.25, 0.5, 0.75))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution runs a round's map stage and its result as a job each.
    assert len(found) == 6 and len(status.getJobIdsForGroup("counting")) <= 12


def test_even_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "f string, v double")
    assert ordering.exact_quantiles(df, ["f"], "v", (0.5,)).first()["quantile"] == 2.5


def test_numeric_profile_equals_pandas(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(10, 3), None if i % 7 == 0 else float(rnd.randint(0, 9)))
            for i in range(333)]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    got = {r["feature"]: r for r in profile.numeric_profile(df, ["i", "a", "b"]).collect()}
    expected = df.toPandas().describe().round(3)
    for c in ("i", "a", "b"):
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(expected[c][theirs], abs=1.01e-3)
    rough = {r["feature"]: r
             for r in profile.numeric_profile(df, ["a"], exact=False).collect()}
    assert rough["a"]["p50"] == pytest.approx(expected["a"]["50%"], abs=0.2)


def test_bins_follow_the_rows():
    assert [ordering.bins_for(n) for n in (0, 1, 10 ** 6)] == [ordering.LEAST_BINS] * 3
    assert ordering.bins_for(10 ** 9) == 4096 and ordering.bins_for(2 ** 30 + 1) == 8192
    assert ordering.bins_for(10 ** 15) == ordering.MOST_BINS


@pytest.mark.parametrize("most", [ordering.MOST_SENT, 0])
def test_results_do_not_depend_on_bins_or_on_what_is_sent(spark, scored, monkeypatch, most):
    monkeypatch.setattr(ordering, "MOST_SENT", most)
    df = spark.createDataFrame(scored, "model string, churn int, p double").repartition(3)
    weights = {"pos": "churn", "all": "1"}

    def rows(bins):
        prefix = ordering.ordered_prefix(df, ["model"], "p", weights, True, bins)
        quantiles = ordering.exact_quantiles(df, ["model"], "p", (0.1, 0.5), weights, bins)
        return [sorted(map(tuple, t.select(sorted(t.columns)).collect())) for t in (prefix, quantiles)]

    expected = rows(None)
    assert len(expected[0]) > 1000 and len(expected[1]) == 12
    for bins in (2, 4096):
        assert rows(bins) == expected
    with pytest.raises(ValueError, match="power of two"):
        rows(1000)


def test_more_bins_than_the_old_fixed_number(spark):
    df = spark.range(20_000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) AS v")
    binned, _ = ordering._binned(df, ["g"], "v", 4096)
    sizes = [r["count"] for r in binned.groupBy("_bin").count().collect()]
    assert len(sizes) > 3000 and max(sizes) < 60
