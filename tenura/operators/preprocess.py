"""Imputation, scaling and one-hot encoding, learned for many training subsets at once.

A fit set is a set of (split, fold) parts. Cross-validation needs one per fold, the refits two
more; they overlap almost fully, so their statistics are learned together: a few counting scans
for all medians, one count per (column, category, part) for modes and categories, and one aggregate
per part for means and variances, which are then combined. The learned values become ordinary
pyspark.ml stages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators import ordering
from tenura.sources.scratch import materialize

Part = tuple[str, int | None]
MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class Preprocessing:
    """What one fit set taught: fill values, scaling, categories and class counts."""

    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]
    rows: int
    positives: int
    feature_names: list[str] = field(default_factory=list)

    @property
    def negatives(self) -> int:
        return self.rows - self.positives


def in_parts(parts: Sequence[Part]) -> str:
    """SQL test for a set of parts, never NULL."""
    tests = []
    for split in sorted({s for s, _ in parts}):
        folds = [f for s, f in parts if s == split]
        numbered = ", ".join(str(f) for f in folds if f is not None)
        tests += [f"(split = '{split}' AND fold IN ({numbered}))"] if numbered else []
        tests += [f"(split = '{split}' AND fold IS NULL)"] if None in folds else []
    return f"coalesce({' OR '.join(tests)}, false)"


def fit_medians(
    df: DataFrame, numeric: Sequence[str], fit_sets: Mapping[str, Sequence[Part]]
) -> dict[str, dict[str, float]]:
    """Exact medians: fit set -> column -> median; no entry where all values are missing."""
    weights = {name: f"CAST({in_parts(parts)} AS INT)" for name, parts in fit_sets.items()}
    medians: dict[str, dict[str, float]] = {name: {} for name in fit_sets}
    found = ordering.counted_quantiles(df, numeric, (0.5,), weights)
    for (column, name, _), value in found.items():
        medians[name][column] = value
    return medians


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (feature, value, split, fold); NULLs left out."""
    pairs = ", ".join(f"named_struct('feature', '{c}', 'value', `{c}`)" for c in columns)
    return (df.selectExpr("split", "fold", f"inline(array({pairs}))")
            .filter("value IS NOT NULL")
            .groupBy("feature", "value", "split", "fold")
            .agg(F.expr("count(1) AS n")))


def fit_modes(
    df: DataFrame, columns: Sequence[str], fit_sets: Mapping[str, Sequence[Part]]
) -> DataFrame:
    """Most frequent value per column and fit set, the smallest among equals."""
    return modes_of(category_counts(df, columns), fit_sets)


def refuse_wide_columns(counts: DataFrame, most: int = MAX_CATEGORIES) -> None:
    """Raise where a column has more categories than one-hot columns make sense for."""
    wide = (counts.groupBy("feature").agg(F.countDistinct("value").alias("n"))
            .filter(F.col("n") > most).collect())
    if wide:
        found = ", ".join(f"{r['feature']}: {r['n']}" for r in wide)
        raise ValueError(f"columns with more than {most} categories ({found}); "
                         "leave them out or group their values")


def modes_of(counts: DataFrame, fit_sets: Mapping[str, Sequence[Part]]) -> DataFrame:
    """``fit_modes`` from the counts of ``category_counts``."""
    sums = counts.groupBy("feature", "value").agg(*[
        F.expr(f"sum(n) FILTER (WHERE {in_parts(parts)}) AS n_{name}")
        for name, parts in fit_sets.items()])
    modes = sums.groupBy("feature").agg(*[
        F.expr(f"min_by(value, struct(-n_{name}, value)) FILTER (WHERE n_{name} > 0) "
               f"AS mode_{name}") for name in fit_sets])
    rows = ", ".join(f"named_struct('weight', '{name}', 'mode', mode_{name})"
                     for name in fit_sets)
    return modes.selectExpr("feature", f"inline(array({rows}))")


def _combine(parts: Sequence[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Merge (count, mean, sum of squared deviations) of disjoint row sets."""
    n = mean = m2 = 0.0
    for count, part_mean, part_m2 in parts:
        if not count:
            continue
        total = n + count
        delta = part_mean - mean
        m2 += part_m2 + delta * delta * n * count / total
        mean += delta * count / total
        n = total
    return n, mean, m2


def fit(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    fit_sets: Mapping[str, Sequence[Part]],
    label: str = "churn",
) -> dict[str, Preprocessing]:
    """Learn all fit sets from a table that carries ``split`` and ``fold``, in a few jobs.

    What reaches the driver are medians, moments per part and categories: sizes set by the columns
    and their categories, not by the rows. A column with more than ``MAX_CATEGORIES`` categories
    is refused before any of them is collected.
    """
    used = sorted({p for parts in fit_sets.values() for p in parts}, key=str)
    df = df.filter(in_parts(used))
    medians = fit_medians(df, numeric, fit_sets)

    def moments_of(c: str) -> list[Column]:
        known = f"FILTER (WHERE NOT isnan(CAST(`{c}` AS DOUBLE)))"
        return [F.expr(f"{fn}(`{c}`) {known} AS `{name}_{c}`")
                for fn, name in (("count", "n"), ("avg", "mean"), ("var_pop", "var"),
                                 ("min", "min"), ("max", "max"))]

    moments = df.groupBy("split", "fold").agg(
        F.expr("count(1) AS rows"), F.expr(f"sum({label}) AS positives"),
        *[m for c in numeric for m in moments_of(c)]).collect()
    by_part = {(r["split"], r["fold"]): r for r in moments}

    modes_by_set: dict[str, dict[str, str]] = {name: {} for name in fit_sets}
    present_in: dict[Part, dict[str, list[str]]] = {}
    if categorical:
        counts = materialize(category_counts(df, categorical), "categories")
        refuse_wide_columns(counts)
        numbers: dict[tuple[Part, str], dict[str, int]] = {}
        for r in counts.collect():
            part = (r["split"], r["fold"])
            present_in.setdefault(part, {}).setdefault(r["feature"], []).append(r["value"])
            numbers.setdefault((part, r["feature"]), {})[r["value"]] = r["n"]
        for name, parts in fit_sets.items():
            for c in categorical:
                sums: Counter[str] = Counter()
                for part in parts:
                    sums.update(numbers.get((part, c), {}))
                if sums:
                    modes_by_set[name][c] = min(sums, key=lambda v: (-sums[v], v.encode()))

    learned = {}
    for name, parts in fit_sets.items():
        present = [by_part[p] for p in parts if p in by_part]
        rows = sum(r["rows"] for r in present)
        means, scales = {}, {}
        fills = {c: medians[name][c] for c in numeric if c in medians[name]}
        for c, median in fills.items():
            pieces = [(r[f"n_{c}"], r[f"mean_{c}"], r[f"n_{c}"] * r[f"var_{c}"])
                      for r in present if r[f"n_{c}"]]
            pieces.append((rows - sum(p[0] for p in pieces), median, 0.0))
            n, mean, m2 = _combine(pieces)
            values = {float(r[f"{k}_{c}"]) for r in present if r[f"n_{c}"] for k in ("min", "max")}
            values |= {median} if pieces[-1][0] else set()
            if len(values) == 1:
                # A constant column: what is left of its variance is rounding.
                means[c], scales[c] = values.pop(), 1.0
            else:
                means[c], scales[c] = mean, (m2 / n) ** 0.5
        modes = {c: modes_by_set[name][c] for c in categorical if c in modes_by_set[name]}
        categories = {c: sorted({v for p in parts for v in present_in.get(p, {}).get(c, ())})
                      for c in modes}
        names = [f"num__{c}" for c in fills] + [
            f"cat__{c}_{v}" for c in categories for v in categories[c]]
        learned[name] = Preprocessing(
            medians=fills, means=means, scales=scales, modes=modes,
            categories=categories, rows=rows, positives=int(sum(r["positives"] for r in present)),
            feature_names=names)
    return learned


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _statement(p: Preprocessing, numeric: Sequence[str]) -> str:
    """The fill and scale step as SQL over the stage's input."""
    terms = ["*"]
    for c in numeric:
        x = f"CAST(`{c}` AS DOUBLE)"
        filled = f"CASE WHEN `{c}` IS NULL OR isnan({x}) THEN {_double(p.medians[c])} ELSE {x} END"
        terms.append(f"(({filled}) - {_double(p.means[c])}) / {_double(p.scales[c])} "
                     f"AS `num__{c}`")
    terms += [f"coalesce(`{c}`, {_text(m)}) AS `{c}__filled`" for c, m in p.modes.items()]
    return f"SELECT {', '.join(terms)} FROM __THIS__"


def to_stages(p: Preprocessing, df: DataFrame) -> PipelineModel:
    """pyspark.ml stages that turn rows like ``df`` into the ``features`` vector.

    Numerics come first, then the one-hot columns in the order of their sorted categories; a value
    unseen in the fit set becomes all zeros. ``df`` is used for its schema only.
    """
    numeric = list(p.medians)
    columns = list(p.categories)
    fill = SQLTransformer(statement=_statement(p, numeric))
    stages = [fill]
    indexed = fill.transform(df.limit(0))
    for c in columns:
        indexer = StringIndexerModel.from_labels(
            p.categories[c], inputCol=f"{c}__filled", outputCol=f"{c}__index",
            handleInvalid="keep")
        indexed = indexer.transform(indexed)
        stages.append(indexer)
    if columns:
        encoder = OneHotEncoder(inputCols=[f"{c}__index" for c in columns],
                                outputCols=[f"cat__{c}" for c in columns])
        stages.append(encoder.fit(indexed))
    stages.append(VectorAssembler(
        inputCols=[f"num__{c}" for c in numeric] + [f"cat__{c}" for c in columns],
        outputCol="features"))
    return PipelineModel(stages=stages)
