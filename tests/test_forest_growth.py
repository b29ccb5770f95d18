"""Forests grown in tasks: the same trees whatever goes to a task, and little of them on the driver."""

import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from tenura.operators import encoded, forest_model, models, preprocess, trees

SETS = {"cv0": [("train", 1)], "all": [("train", 0), ("train", 1)]}


def prepared(spark, n, keys=None):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, z, s = float(rng.normal()), float(rng.normal()), "abc"[rng.integers(0, 3)]
        p = 1 / (1 + np.exp(-(1.5 * x - z + (s == "b"))))
        rows.append((keys(i) if keys else i, None if i % 17 == 0 else x, z,
                     None if i % 23 == 0 else s, int(rng.random() < p), "train", i % 2))
    data = spark.createDataFrame(rows, "customer_id long, x double, z double, s string, "
                                       "churn int, split string, fold int")
    learned = preprocess.fit(data, ["x", "z"], ["s"], SETS)
    return data, learned, encoded.encode(data, ["x", "z"], ["s"], learned, SETS, "customer_id",
                                         "churn")


def nodes(tree):
    return sorted(zip(tree.place, tree.col, tree.cut, np.round(tree.value, 9),
                      np.round(tree.gain, 6)))


@pytest.mark.parametrize("keys", [None, lambda i: None if i % 9 == 0 else i // 3],
                         ids=["keys", "repeated and null keys"])
def test_trees_do_not_depend_on_what_goes_to_tasks(spark, keys):
    _, learned, rows = prepared(spark, 400, keys)
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    f = trees.Forest(trees=4, depth=6, min_leaf=3)
    passes = trees.grow_forest(rows, weights, f, in_task=0)
    split = rows.rows.repartition(3)
    for other in (trees.grow_forest(rows, weights, f),
                  trees.grow_forest(encoded.Encoded(**{**rows.__dict__, "rows": split}), weights,
                                    f, cells=200, in_task=60)):
        for name in passes:
            assert [nodes(t) for t in other[name]] == [nodes(t) for t in passes[name]]
            for tree in other[name]:
                for i in np.flatnonzero(np.array(tree.col) >= 0):
                    assert tree.place[tree.left[i]] == 2 * tree.place[i]
                    assert tree.place[tree.left[i] + 1] == 2 * tree.place[i] + 1
    assert len({len(t.col) for t in passes["all"]}) > 1


def test_the_driver_holds_few_trees(spark):
    """Its Python memory is a small part of what all trees' nodes take as objects."""
    _, learned, rows = prepared(spark, 3000)
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    f = trees.Forest(trees=60, depth=10, min_leaf=3)
    tracemalloc.start()
    grown = trees.grow_forest(rows, weights, f)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    count = sum(len(t.col) for name in grown for t in grown[name])
    assert count > 20_000 and peak < 60 * count


def test_a_stored_forest_scores_alike(spark, tmp_path):
    data, learned, rows = prepared(spark, 400)
    fits = models.random_forest(6, 5, 3).fit_sets(rows)
    stage = fits.model("all")
    model = models.pipeline(learned["all"], stage, data)
    path = str(tmp_path / "model")
    for _ in range(2):
        model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    before, after = (sorted(models.with_probability(m, data).select("customer_id", "p").collect())
                     for m in (model, loaded))
    assert before == after and len({r.p for r in before}) > 50
    want = {r.key: r.p for r in fits.scores("all", [0, 1]).collect()}
    assert {r.customer_id: r.p for r in before} == pytest.approx(want, abs=1e-9)
    assert list(loaded.stages[-1].featureImportances) == list(stage.featureImportances)
    assert sum(stage.featureImportances) == pytest.approx(1.0)
    out = loaded.transform(data).select("prediction", "probability").first()
    assert out.prediction == float(out.probability[1] > 0.5)


def test_nodes_travel_compressed(spark):
    """What scoring sends to tasks is smaller than the arrays and comes out the same."""
    _, learned, rows = prepared(spark, 3000)
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    grown = trees.grow_forest(rows, weights, trees.Forest(trees=20, depth=10, min_leaf=3))
    for sent in (grown.packed("all"), models._forest_model(grown, "all", rows, rows.sets["all"]).nodes):
        own = vars(sent)
        assert len(pickle.dumps(sent)) < 0.6 * sum(v.nbytes for v in own.values())
        for name, values in vars(pickle.loads(pickle.dumps(sent))).items():
            assert values.dtype == own[name].dtype and (values == own[name]).all()
    coded = grown.packed("all")
    assert [len(t[0]) for t in coded.trees()] == [len(t.col) for t in grown["all"]]
    bare = trees.Forests(["all"], [], 1, 3, 0).packed("all")
    assert [t[1].tolist() for t in pickle.loads(pickle.dumps(bare)).trees()] == [[0]] * 3


def test_a_model_is_loaded_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest_model, "STORED", 50)
    data, learned, rows = prepared(spark, 400)
    model = models.random_forest(6, 5, 3).fit_sets(rows).model("all")
    assert len(model.nodes.feature) > 150
    model.write().save(str(tmp_path / "stage"))
    sizes, whole = [], type(data).toArrow
    monkeypatch.setattr(type(data), "toArrow",
                        lambda self: (found := whole(self), sizes.append(found.num_rows))[0])
    loaded = forest_model.ForestModel.load(str(tmp_path / "stage"))
    assert max(sizes) <= 50
    for name, values in vars(model.nodes).items():
        assert (getattr(loaded.nodes, name) == values).all()


def test_memory_is_given_back_after_every_stored_and_loaded_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest_model, "STORED", 50)
    released = []
    monkeypatch.setattr(forest_model, "release", released.append)
    _, _, rows = prepared(spark, 400)
    model = models.random_forest(6, 5, 3).fit_sets(rows).model("all")
    parts = -(-len(model.nodes.feature) // 50)
    assert parts > 3
    model.write().save(str(tmp_path / "stage"))
    assert len(released) == parts
    forest_model.ForestModel.load(str(tmp_path / "stage"))
    assert len(released) == 2 * parts
