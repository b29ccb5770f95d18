import numpy as np
import pandas as pd
import pytest
import xxhash

from tenura.llm import simhash
from tenura.llm.components import connected_components
from tenura.sources.scratch import materialize


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = ([b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3
                else [b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def brute_groups(prints):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1:]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_documents_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    groups = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints}


@pytest.mark.parametrize("limit", [4096, 1])
def test_planted_fingerprints_at_any_cell_limit(spark, limit):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = [(i, p) for i, p in enumerate(sorted(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), 3, limit)
    got = {tuple(sorted((r.a, r.b))) for r in pairs.collect()}
    value = dict(prints)
    want = {(i, j) for i in value for j in value
            if i < j and bin(value[i] ^ value[j]).count("1") <= 3}
    assert got == want


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "A b", "x"), (5, "a B", "x"),
            (6, long, "x"), (7, long, "x"), (7, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6)]
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(500)]
    got = connected_components(spark.createDataFrame(
        pd.DataFrame(pairs, columns=["x", "y"]))).toPandas()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert dict(zip(got.node, got.component, strict=True)) == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def test_exploded_rows_are_not_broadcast(spark):
    """Cells are joined by shuffle, however small Spark takes the points to be."""
    points = [(i * 0x9E3779B97F4A7C15 % 2**63,) * 2 for i in range(500)]
    points += [(fp ^ 5, fp ^ 5) for fp, _ in points[:100]]
    stored = materialize(spark.createDataFrame(points, "fp long, rep long"), "test-points")
    for limit in (simhash.CELL_LIMIT, 1):
        found = simhash.links(stored, cell_limit=limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [half" in plan
        for line in plan.splitlines():
            assert not ("BroadcastHashJoin" in line and "Inner" in line), line
        links = {(min(r), max(r)) for r in found.collect()}
        assert {(min(fp, fp ^ 5), max(fp, fp ^ 5)) for fp, _ in points[:100]} <= links
