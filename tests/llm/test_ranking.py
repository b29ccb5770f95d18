import numpy as np

from tenura.llm import queries, ranking


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    n = label.sum()
    return (ranks[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_documents(spark, medium):
    rows = queries.op7_ranking(spark, medium)
    assert rows.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    labels = spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "quality")
    got = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 60 and got.quality.nunique() == 2
    assert auc(got.score.values, got.quality.values) > 0.95
    assert (got.predicted == got.quality).mean() > 0.9
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(2)
    true = rng.normal(size=len(ranking.FEATURES))
    x = rng.normal(size=(4000, len(true)))
    good = rng.random(4000) < 1 / (1 + np.exp(-(x @ true)))
    t = ranking.Training(partners=3)
    r = ranking.fit(x[good], x[~good], good.mean(), t)
    assert np.corrcoef(r.weights, true)[0, 1] > 0.98
    shares = r.score(x) >= t.threshold
    assert abs(shares.mean() - good.mean()) < 0.01


def test_labels_of_held_out_documents_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    turned = labels.selectExpr("doc_id", "quality") .withColumn(
        "quality", ranking.F.when(ranking.held_out(ranking.F.col("doc_id")),
                                  1 - ranking.F.col("quality")).otherwise(
            ranking.F.col("quality")))
    a = {r.doc_id: r.score for r in ranking.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in ranking.score(docs, turned).collect()}
    assert a == b


def test_edge_rows(spark):
    long = "word another " * 40_000
    rows = [(1, None, 0.5), (2, "", 0.5), (3, " \n", 0.5), (4, long, 0.5), (4, long, 0.5),
            (None, "a few words.", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (3, None), (4, 1)],
                                   "doc_id long, good int")
    for known in (labels, labels.limit(0)):
        got = ranking.score(docs, known).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert ranking.score(docs.limit(0), labels).count() == 0


def labelled_rows(spark, n):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list("abcde#9"), rng.integers(1, 9)))
                         for _ in range(rng.integers(5, 40))), int(rng.random() < 0.3))
            for i in range(n)]
    data = spark.createDataFrame(rows, "doc_id long, text string, good int")
    return data.select("doc_id", "text"), data.select("doc_id", "good")


def test_threshold_covers_all_labelled_documents(spark):
    docs, labels = labelled_rows(spark, 800)
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))
    for training in (ranking.Training(), ranking.Training(sample=40)):
        got = ranking.score(docs, labels, training).where("not held_out").join(
            labels, "doc_id").toPandas()
        cut = np.sort(got.worth.values)[(got.good == 0).sum() - 1]
        assert (got.predicted == (got.worth >= cut)).all()
        at = got.score[got.worth == cut]
        assert np.allclose(at, training.threshold, atol=1e-9)


def test_sample_is_bounded_where_rows_share_an_id(spark, monkeypatch):
    docs, labels = labelled_rows(spark, 400)
    docs = docs.selectExpr("CASE WHEN doc_id < 300 THEN doc_id % 5 ELSE doc_id END AS doc_id", "text")
    docs = docs.unionByName(docs)
    seen, fit = [], ranking.fit
    monkeypatch.setattr(ranking, "fit", lambda good, bad, *a: seen.extend(
        (len(good), len(bad))) or fit(good, bad, *a))
    ranking.score(docs, labels.replace({1: 0}, subset="good").where("doc_id < 5").unionByName(
        labels.where("doc_id >= 350")), ranking.Training(sample=50)).count()
    assert 0 < max(seen) <= 80
