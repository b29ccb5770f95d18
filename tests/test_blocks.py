"""Passes over blocks: no single values reach a task, and sums equal plain loops."""

import numpy as np
import pytest

from tenura.operators import encoded, models, preprocess, trees

SETS = {"cv0": [("train", 1)], "all": [("train", 0), ("train", 1)]}


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x, z, s = float(rng.normal()), float(rng.integers(0, 9)), "abc"[rng.integers(0, 3)]
        p = 1 / (1 + np.exp(-(1.5 * x - 0.4 * z + (s == "b"))))
        rows.append((None if i % 50 == 7 else f"k{i // 2}", None if i % 17 == 0 else x, z,
                     None if i % 23 == 0 else s, int(rng.random() < p), "train", i % 2))
    data = spark.createDataFrame(rows, "customer_id string, x double, z double, s string, "
                                       "churn int, split string, fold int")
    learned = preprocess.fit(data, ["x", "z"], ["s"], SETS)
    return learned, encoded.encode(data, ["x", "z"], ["s"], learned, SETS, "customer_id", "churn")


def test_blocks_hold_all_rows(prepared):
    _, rows = prepared
    blocks = encoded.in_blocks(rows, margins=2, keys=True)
    kind, found = encoded.code_type(rows), []
    records = blocks.table.toArrow().to_batches()
    for block in encoded.opened(iter(records), kind):
        assert block.margins.shape == (2, len(block.label))
        found += zip(encoded.keys_of(block).to_pylist(), block.key_hash.view(np.int64).tolist(),
                     block.label.tolist(), block.part.tolist(), block.codes.T.tolist())
    want = [(r.key, r.key_hash, r.label, r.part, r.codes) for r in rows.rows.collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) == 600
    assert sum(b.num_rows for b in records) < 60


def test_passes_get_records_and_not_rows(prepared, monkeypatch):
    """Before, every pass over the rows took each of their values through Spark's rows."""
    learned, rows = prepared
    read = []
    whole = encoded.summed_blocks

    def watched(blocks, *more):
        read.append(blocks.table.count())
        return whole(blocks, *more)

    monkeypatch.setattr(trees, "summed_blocks", watched)
    trees.boost(rows, {s: models.positive_weights(p) for s, p in learned.items()},
                trees.Boosting(rounds=2))
    trees.grow_forest(rows, {s: models.balanced_weights(p) for s, p in learned.items()},
                      trees.Forest(trees=2, depth=3), in_task=0)
    assert len(read) >= 9 and max(read) <= 30


def test_sums_do_not_depend_on_who_adds_them(prepared, monkeypatch):
    learned, rows = prepared
    weights = {s: models.positive_weights(p) for s, p in learned.items()}
    found = []
    for few in (encoded.FEW_TASKS, 0):
        monkeypatch.setattr(encoded, "FEW_TASKS", few)
        boosted, margins = trees.boost(rows, weights, trees.Boosting(rounds=4))
        forest = trees.grow_forest(rows, weights, trees.Forest(trees=3, depth=5), in_task=0)
        found.append(([(t.col, t.cut) for s in boosted for t in boosted[s]],
                      [sorted(zip(t.place, t.col, t.cut)) for s in forest for t in forest[s]],
                      sorted((str(r.key), r.label, np.round(r.margins, 9).tolist())
                             for r in margins.collect())))
    assert found[0] == found[1] and len(found[0][2]) == 600


@pytest.mark.parametrize("fills", [(2, 1, 3), (2, 1, -1)], ids=["filled", "one without a fill"])
def test_kernels_equal_plain_loops(fills):
    rng = np.random.default_rng(1)
    sizes, inputs, n = np.array([5, 3, 4]), 2, 400
    codes = np.stack([rng.integers(-1, size, n) for size in sizes]).astype(np.int8)
    filled = np.where(codes < 0, np.array(fills)[:, None], codes)
    tree = trees.Tree(inputs)
    a, b = tree.split(tree.add(1, (0, 0), 0.0), 0, 2, 1.0, (0, 0), (0, 0), (0.1, 0.2))
    c, _ = tree.split(a, 2, 3, 1.0, (0, 0), (0, 0), (0.3, 0.4))
    tree.split(c, 1, 0, 1.0, (0, 0), (0, 0), (0.5, 0.6))
    arrays = trees.arrays(tree)
    want = trees.leaves(filled.T, arrays, inputs, 3)
    got = trees._walked(codes, trees._gaps(codes), arrays, inputs, np.array(fills))
    assert got.tolist() == want.tolist() and len(set(want)) > 3

    at, values = rng.integers(0, 3, n), [rng.normal(size=n), rng.random(n)]
    total, plain = np.zeros((3, 12, 2)), np.zeros((3, 12, 2))
    trees._add_histograms(total, codes.astype(int), at, values, sizes, 6, np.array(fills))
    starts = [0, 5, 8]
    for row in range(n):
        for i in range(3):
            if filled[i, row] >= 0:
                for v in (0, 1):
                    plain[at[row], starts[i] + filled[i, row], v] += values[v][row]
    assert total == pytest.approx(plain)

    s = encoded.FillSet(None, None, None, None, np.array(fills[:2]), np.array(fills[2:]), [], None,
                        None)
    layout = trees.Layout(inputs, np.array([2]), 6, np.int8)
    flat = layout.spread(codes, [s])[0]
    base, steps = np.arange(n) * 6, layout.steps(arrays)
    assert trees._routed(flat, base, steps, 3).tolist() == want.tolist()
    cols, cats = np.array([[0, 2], [1, 2], [2, 1]]), np.array([[0, 1], [0, 3], [2, 0]])
    one, draws = rng.integers(0, 2, n), rng.integers(1, 4, n)
    got = trees._forest_sums(flat, base, one, draws * float(trees.DRAW) + 1, (0.7, 1.9), at,
                             layout.feature(cols, cats), 5)
    plain = np.zeros((3, 2, 5, 3))
    for row in range(n):
        for slot in range(2):
            col, cat = cols[at[row], slot], cats[at[row], slot]
            code = filled[col, row] if col < inputs else int(filled[col, row] == cat)
            plain[at[row], slot, code] += [draws[row] * 0.7 * (one[row] == 0),
                                           draws[row] * 1.9 * (one[row] == 1), 1]
    assert got == pytest.approx(plain)
