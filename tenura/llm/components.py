"""Connected components of an edge table by alternating star contraction.

Every step is a grouped minimum (partial sums before the shuffle) and a join that adaptive
execution can split, so a node that touches a large share of all edges costs no task of its own.
Edges stay in the shared scratch folder between steps; nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.sources.scratch import materialize


def _to_minimum(directed: DataFrame, keep_own: bool) -> DataFrame:
    """``directed`` (u, v): every v, and u itself if asked, linked to the least node around u."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = directed.join(least, "u")
    out = linked.where("v > u" if not keep_own else "v <> m").select(F.col("v").alias("a"),
                                                                     F.col("m").alias("b"))
    if keep_own:
        out = out.unionByName(least.where("u <> m").select(F.col("u").alias("a"),
                                                           F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _to_minimum(both, keep_own=False)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _to_minimum(down, keep_own=True)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"),
                    F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node on an edge; component is the least node reachable.

    ``edges`` has two columns of one ordered type; repeated edges, loops and both directions are
    fine, edges with a null end are ignored, and no edges give no rows.
    """
    a, b = edges.columns
    pairs = (edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
             .where("a is not null and b is not null and a <> b").distinct())
    pairs = materialize(pairs, name)
    state = _state(pairs)
    while state[0]:
        pairs = materialize(_small_star(_large_star(pairs)), name)
        before, state = state, _state(pairs)
        if state == before:
            break
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")))
            .distinct())
