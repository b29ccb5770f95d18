"""Stratified parts and class weights."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tenura.operators import splits


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1000).selectExpr("id AS customer_id", "IF(id % 7 < 2, 1, 0) AS churn")


def brute(n_rows, folds=5, test=0.2, validation=0.2):
    parts = {}
    for label in (0, 1):
        ids = [i for i in range(n_rows) if (1 if i % 7 < 2 else 0) == label]
        ids.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        n_test = int(len(ids) * test + 0.5)
        n_val = int((len(ids) - n_test) * validation + 0.5)
        rest = len(ids) - n_test - n_val
        for rank, i in enumerate(ids):
            if rank < n_test:
                parts[i] = ("test", None)
            elif rank < n_test + n_val:
                parts[i] = ("validation", None)
            else:
                parts[i] = ("train", (rank - n_test - n_val) * folds // rest)
    return parts


def parts_of(df, **params):
    return {r["customer_id"]: (r["split"], r["fold"])
            for r in splits.stratified(df, **params).collect()}


def test_equals_brute_force_whatever_the_partitioning(labelled):
    expected = brute(1000)
    assert parts_of(labelled) == expected
    assert parts_of(labelled.orderBy(F.rand(3)).repartition(13)) == expected


def test_seed_and_fold_count_matter(labelled):
    assert parts_of(labelled, seed=7) != parts_of(labelled)
    assert {f for s, f in parts_of(labelled, folds=3).values() if s == "train"} == {0, 1, 2}


def test_folds_keep_the_class_ratio(labelled):
    rows = splits.stratified(labelled).filter("split = 'train'").groupBy("fold").agg(
        F.count("*").alias("n"), F.avg("churn").alias("rate")).collect()
    assert len(rows) == 5
    assert max(r["n"] for r in rows) - min(r["n"] for r in rows) <= 2
    assert all(abs(r["rate"] - 286 / 1000) < 0.01 for r in rows)


def test_known_sizes(spark, medium):
    from tenura.plans import catalog
    counts = {(r["split"], r["churn"]): r["count"] for r in
              catalog.split_assignment(spark, medium).groupBy("split", "churn").count().collect()}
    assert counts == {("train", 0): 566, ("train", 1): 394, ("validation", 0): 142,
                      ("validation", 1): 98, ("test", 0): 177, ("test", 1): 123}


def test_copies_of_a_key_stay_together(spark, labelled):
    hot = spark.range(500).selectExpr("5L AS customer_id", "1 AS churn")
    rows = splits.stratified(labelled.filter("customer_id <> 5").unionByName(hot))
    per_key = rows.groupBy("customer_id").agg(F.count_distinct("split").alias("n"))
    assert per_key.filter("n <> 1").count() == 0
    assert rows.filter("split IS NULL").count() == 0


def test_tiny_classes(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(6)], "customer_id long, churn int")
    rows = splits.stratified(df).collect()
    assert len(rows) == 6 and all(r["split"] for r in rows)
    assert splits.stratified(df.limit(0)).count() == 0


def test_rows_without_a_label_are_refused(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "customer_id long, churn int")
    with pytest.raises(ValueError, match="1 rows have no churn"):
        splits.stratified(df)
