"""Stratified splits and folds with exact class counts, decided by a hash order of the key.

Within each class, customers are ordered by md5(seed:key). The first share is the test set, the
next the validation set, and the rest is cut into equal folds. A split is fully described by the
last (hash, key) of each part, a handful of values. Those are found from counts per hash prefix
plus the rows of the few prefixes that hold a boundary; assigning the parts is then a projection,
so the wide feature rows are never shuffled for it. The result depends on keys, labels and seed
only, not on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as fv

PREFIX_DIGITS = 3


@dataclass(frozen=True)
class Boundary:
    """Last member of a part within a class."""

    label: int
    part: int
    hash: str
    key: str


def hash_of(key: str, seed: int) -> str:
    """SQL expression of the order's hash."""
    return f"md5(concat('{seed}:', CAST(`{key}` AS STRING)))"


def part_names(folds: int) -> list[tuple[str, int | None]]:
    """Parts in hash order as (split, fold)."""
    return [("test", None), ("validation", None), *[("train", k) for k in range(folds)]]


def _part_ends(test: float, validation: float, folds: int) -> str:
    """SQL array: the last rank of every part within a class of ``total`` rows."""
    held_out = f"round(total * {test!r}D)"
    tuned = f"round((total - {held_out}) * {validation!r}D)"
    rest = f"(total - {held_out} - {tuned})"
    ends = [held_out, f"{held_out} + {tuned}"]
    ends += [f"{held_out} + {tuned} + ceil({rest} * {k + 1} / {folds})" for k in range(folds)]
    return f"array({', '.join(f'CAST({e} AS BIGINT)' for e in ends)})"


def fit_boundaries(
    df: DataFrame,
    key: str = "customer_id",
    label: str = "churn",
    seed: int = fv.SEED,
    test: float = fv.TEST_SHARE,
    validation: float = fv.VALIDATION_SHARE,
    folds: int = fv.CV_FOLDS,
) -> list[Boundary]:
    """The last member of every part of every class: at most classes * (folds + 2) values.

    Rows without a label are refused, as no part could hold them.
    """
    missing = df.filter(f"`{label}` IS NULL").count()
    if missing:
        raise ValueError(f"{missing} rows have no {label}")
    keyed = (df.selectExpr(f"`{label}` AS label", f"CAST(`{key}` AS STRING) AS key",
                           f"{hash_of(key, seed)} AS hash")
             .selectExpr("*", f"substring(hash, 1, {PREFIX_DIGITS}) AS prefix"))
    sizes = keyed.groupBy("label", "prefix").agg(F.expr("count(1) AS size"))
    before = "ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    placed = sizes.selectExpr(
        "label", "prefix", "size",
        f"coalesce(sum(size) OVER (PARTITION BY label {before}), 0) AS offset",
        "sum(size) OVER (PARTITION BY label) AS total")
    targets = (placed.selectExpr(
                   "label", "prefix", "size", "offset",
                   f"posexplode({_part_ends(test, validation, folds)}) AS (part, end)")
               .filter("offset < end AND end <= offset + size")
               .groupBy("label", "prefix", "offset")
               .agg(F.expr("collect_list(struct(part, end)) AS ends")))
    # targets: at most classes * (folds + 2) rows
    rows = (keyed.join(F.broadcast(targets), ["label", "prefix"])
            .groupBy("label", "prefix", "offset", "ends", "hash", "key")
            .agg(F.expr("count(1) AS copies"))
            .selectExpr("label", "hash", "key", "ends", "copies",
                        "offset + sum(copies) OVER (PARTITION BY label, prefix "
                        "ORDER BY hash, key ROWS UNBOUNDED PRECEDING) AS upto")
            .selectExpr("label", "hash", "key", "copies", "upto", "inline(ends)")
            .filter("upto >= end AND upto - copies < end"))
    return [Boundary(r["label"], r["part"], r["hash"], r["key"])
            for r in rows.select("label", "part", "hash", "key").collect()]


def assign(
    df: DataFrame,
    boundaries: list[Boundary],
    key: str = "customer_id",
    label: str = "churn",
    seed: int = fv.SEED,
    folds: int = fv.CV_FOLDS,
) -> DataFrame:
    """Add ``split`` and ``fold`` (NULL outside the training rows) by comparing with boundaries.

    Store the result before filtering on the new columns: a filter pushed below this projection
    would repeat its comparisons.
    """
    arms = []
    for b in sorted(boundaries, key=lambda b: (b.label, b.part)):
        # Hashes are equally long, so (hash, key) orders like the concatenation.
        arms.append(f"WHEN `{label}` = {b.label} AND _mark <= {_literal(b.hash + b.key)} "
                    f"THEN {b.part}")
    part = f"CASE {' '.join(arms)} END" if arms else "CAST(NULL AS INT)"
    names = part_names(folds)
    splits = ", ".join(f"'{s}'" for s, _ in names)
    numbers = ", ".join("CAST(NULL AS INT)" if f is None else str(f) for _, f in names)
    return (df.selectExpr("*", f"concat({hash_of(key, seed)}, CAST(`{key}` AS STRING)) AS _mark")
            .selectExpr("*", f"{part} AS _part")
            .selectExpr("*", f"get(array({splits}), _part) AS split",
                        f"get(array({numbers}), _part) AS fold")
            .drop("_mark", "_part"))


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def stratified(df: DataFrame, **params) -> DataFrame:
    """``fit_boundaries`` and ``assign`` in one call."""
    used = {k: v for k, v in params.items() if k in ("key", "label", "seed", "folds")}
    return assign(df, fit_boundaries(df, **params), **used)

