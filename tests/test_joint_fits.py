"""Fits of all fit sets at once against plain loops over the same rows."""

import numpy as np
import pytest

from tenura.operators import encoded, models, newton, preprocess, trees
from tenura.operators.encoded import drawn

SETS = {"cv0": [("train", 1), ("train", 2)], "cv1": [("train", 0), ("train", 2)],
        "all": [("train", 0), ("train", 1), ("train", 2)]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        x, z = float(rng.normal()), float(rng.integers(0, 6))
        s = "abc"[rng.integers(0, 3)]
        p = 1 / (1 + np.exp(-(1.5 * x - 0.4 * z + (s == "b"))))
        rows.append((i, None if i % 17 == 0 else x, z, None if i % 23 == 0 else s,
                     int(rng.random() < p), "train", i % 3))
    return spark.createDataFrame(rows, "customer_id long, x double, z double, s string, "
                                       "churn int, split string, fold int")


@pytest.fixture(scope="module")
def learned(data):
    return preprocess.fit(data, ["x", "z"], ["s"], SETS)


@pytest.fixture(scope="module")
def rows(data, learned):
    return encoded.encode(data, ["x", "z"], ["s"], learned, SETS, "customer_id", "churn")


def plain(rows):
    """The stored rows as arrays."""
    found = sorted(rows.rows.collect(), key=lambda r: r.key)
    return (np.array([r.codes for r in found]), np.array([r.label for r in found]),
            np.array([r.part for r in found]),
            np.array([r.key_hash for r in found], np.int64).view(np.uint64))


def grown_alone(codes, y, part, keys, s, pair, b, k, sizes, inputs):
    """Boosting of one fit set by plain loops over all candidates of all nodes."""
    codes = encoded.filled_codes(codes, s)
    margin, out = np.zeros(len(y)), []
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    for r in range(b.rounds):
        allowed = trees._allowed(s, sizes, b.column_share, (b.seed, r, k))
        mine = s.member[part] & (drawn(keys, b.seed, r) < b.row_share)
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, pair[1], pair[0])
        g, h = w * (p - y), w * p * (1 - p)

        def grow(inside, everyone, level):
            big_g, big_h = g[inside].sum(), h[inside].sum()
            best = None
            if level < b.depth:
                for c in np.flatnonzero(allowed):
                    col = int(np.searchsorted(offsets, c, side="right") - 1)
                    cut = c - offsets[col]
                    right = codes[:, col] > cut if col < inputs else codes[:, col] == cut
                    gl, hl = g[inside & ~right].sum(), h[inside & ~right].sum()
                    gr, hr = big_g - gl, big_h - hl
                    if min(hl, hr) < b.least_curve:
                        continue
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - big_g**2 / (big_h + 1)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, right)
            if best is None:
                out_margin[everyone] = -b.rate * big_g / (big_h + 1)
                return 1
            return 1 + grow(inside & ~best[1], everyone & ~best[1], level + 1) + grow(
                inside & best[1], everyone & best[1], level + 1)

        out_margin = np.zeros(len(y))
        out.append(grow(mine, np.ones(len(y), bool), 0))
        margin += out_margin
    return margin, out


def test_boosting_equals_plain_loops(rows, learned):
    b = trees.Boosting(rounds=12, rate=0.3)
    weights = {s: models.positive_weights(p) for s, p in learned.items()}
    grown, margins = trees.boost(rows, weights, b)
    got = np.array([r.margins for r in sorted(margins.collect(), key=lambda r: r.key)])
    codes, y, part, keys = plain(rows)
    for k, name in enumerate(rows.names):
        want, nodes = grown_alone(codes, y, part, keys, rows.sets[name], weights[name], b, k,
                                  rows.sizes(), 2)
        assert [len(t.col) for t in grown[name]] == nodes
        assert got[:, k] == pytest.approx(want, abs=1e-9)


def test_newton_equals_the_dense_optimum(rows, learned):
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    found = newton.fit(rows, weights)
    batch = encoded.Batch(np.array([r.x for r in rows.rows.collect()]),
                          np.array([r.codes for r in rows.rows.collect()]),
                          np.array([r.label for r in rows.rows.collect()]),
                          np.array([r.part for r in rows.rows.collect()]), None, None)
    for name in rows.names:
        s = rows.sets[name]
        mine = s.member[batch.part]
        x, y = encoded.design(batch, s)[mine], batch.label[mine]
        w = np.where(y == 1, weights[name][1], weights[name][0])
        p = 1 / (1 + np.exp(-x @ found[name]))
        slope = x.T @ (w * (p - y)) + np.append(found[name][:-1], 0)
        assert np.abs(slope).max() < 1e-8
    one_class = {s: (1.0, 1.0) for s in weights}
    assert all(np.isfinite(v).all() for v in newton.fit(rows, one_class, max_iter=5).values())


def test_forests_do_not_depend_on_passes_or_files(rows, learned):
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    f = trees.Forest(trees=6, depth=5, min_leaf=3)
    one = trees.grow_forest(rows, weights, f)
    many_files = encoded.Encoded(**{**rows.__dict__, "rows": rows.rows.repartition(5), "files": 99})
    for other in (trees.grow_forest(rows, weights, f, cells=200),
                  trees.grow_forest(many_files, weights, f)):
        for name in one:
            for a, b in zip(one[name], other[name]):
                # Nodes may be made in another order; their places and splits are the same.
                key = [sorted(zip(t.place, t.col, t.cut, np.round(t.value, 9))) for t in (a, b)]
                assert key[0] == key[1]
    sizes = [len(t.col) for t in one["all"]]
    assert min(sizes) > 1 and len(set(sizes)) > 1


def test_forest_leaves_hold_enough_rows_and_split_on_the_best_slot(rows, learned):
    weights = {s: models.balanced_weights(p) for s, p in learned.items()}
    f = trees.Forest(trees=3, depth=4, min_leaf=5)
    grown = trees.grow_forest(rows, weights, f)
    codes, y, part, keys = plain(rows)
    for k, name in enumerate(rows.names):
        s, pair = rows.sets[name], weights[name]
        own = encoded.filled_codes(codes, s)
        for t, tree in enumerate(grown[name]):
            draws = trees._poisson(drawn(keys, f.seed, t))
            mine = s.member[part] & (draws > 0)
            w = draws * np.where(y == 1, pair[1], pair[0])
            at = trees.leaves(own, trees.arrays(tree), 2, f.depth)
            for leaf in np.flatnonzero(np.array(tree.col) < 0):
                inside = mine & (at == leaf)
                assert inside.sum() >= 5 or len(tree.col) == 1
                assert tree.value[leaf] == pytest.approx(w[inside & (y == 1)].sum() / w[inside].sum())
            if tree.col[0] < 0:
                continue
            cols, cats = trees._slots(list(rows.sets.values()), np.array([k]), np.array([t]),
                                      np.array([1]), f.seed)

            def gini(inside):
                total = w[inside].sum()
                one = w[inside & (y == 1)].sum()
                return total - (one**2 + (total - one)**2) / total if total else 0.0

            gains = []
            for col, cat in zip(cols[0], cats[0]):
                for cut in [cat] if col >= 2 else range(rows.sizes()[col]):
                    right = own[:, col] == cut if col >= 2 else own[:, col] > cut
                    if min((mine & right).sum(), (mine & ~right).sum()) >= 5:
                        gains.append(gini(mine) - gini(mine & right) - gini(mine & ~right))
            assert tree.gain[0] == pytest.approx(max(gains))


@pytest.mark.parametrize("candidate", [
    models.logistic_regression(), models.random_forest(5, 4), models.boosted_trees(5)],
    ids=lambda c: c.name)
def test_spark_models_score_like_the_fits(candidate, data, learned, rows):
    fits = candidate.fit_sets(rows)
    for name, part in (("cv0", 0), ("cv1", 1), ("all", 2)):
        want = {r.key: r.p for r in fits.scores(name, [part]).collect()}
        model = models.pipeline(learned[name], fits.model(name), data)
        got = {r.customer_id: r.p for r in
               models.with_probability(model, data.where(f"fold = {part}")).collect()}
        assert got == pytest.approx(want, abs=1e-9) and len(got) > 60
        assert len(set(got.values())) > 5


def test_draws_are_even_and_poisson_has_its_mean():
    keys = np.arange(100_000, dtype=np.uint64)
    u = drawn(keys, 42, 1)
    assert abs(u.mean() - 0.5) < 0.01 and 0 <= u.min() and u.max() < 1
    assert abs(np.corrcoef(u, drawn(keys, 42, 2))[0, 1]) < 0.02
    counts = trees._poisson(u)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.03


def test_constant_and_empty_inputs(spark):
    rows = [(i, 1.0, None, i % 2, "train", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id long, x double, s string, churn int, "
                                     "split string, fold int")
    sets = {"all": [("train", 0), ("train", 1)], "one": [("train", 0)]}
    learned = preprocess.fit(df, ["x"], ["s"], sets)
    enc = encoded.encode(df, ["x"], ["s"], learned, sets, "customer_id", "churn")
    for candidate in (models.logistic_regression(20), models.random_forest(3, 3),
                      models.boosted_trees(3)):
        fits = candidate.fit_sets(enc)
        for s in sets:
            p = [r.p for r in fits.scores(s, [0, 1]).collect()]
            assert len(p) == 40 and all(0 <= v <= 1 for v in p)
