"""Exact order statistics without bringing an order into one task.

A plain ``Window.orderBy`` needs all rows of a group in one task. Here the value axis of each group
is cut at approximate quantiles, counts before each bin come from a small per-bin table, and only
rows of one bin meet in a task. The cuts only balance the bins; the results are exact. Rows are
reduced to one per distinct value before the shuffle, so a value held by many rows costs one row.

The cuts come from one mergeable sketch per group and are stored, since sketches draw at random: every
pass sees the same ones. There are as many bins as the largest group's rows ask for. Cuts and bin
counts are broadcast if all groups together have few of them, and joined by shuffle otherwise.
Quantiles of whole columns need no order at all: ``counted_quantiles`` finds them by counting.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.scalars import with_count_at_or_below
from tenura.sources.scratch import drop, materialize

# Rows of the largest group per bin, and the least and most bins; powers of two.
BIN_ROWS = 1 << 18
LEAST_BINS = 64
MOST_BINS = 1 << 16
# Cuts of all groups that may be sent to every task: some tens of MB.
MOST_SENT = 1 << 21
CELL_BITS = 11


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep.., feature, value) of numeric columns, values as doubles."""
    pairs = ", ".join(f"named_struct('feature', '{c}', 'value', CAST(`{c}` AS DOUBLE))"
                      for c in columns)
    return df.selectExpr(*keep, f"inline(array({pairs}))")


def _known(df: DataFrame, value: str) -> DataFrame:
    return df.filter(f"`{value}` IS NOT NULL AND NOT isnan(`{value}`)")


def bins_for(rows: int) -> int:
    """Bins for a group of ``rows`` rows: a power of two, BIN_ROWS rows each where bounds allow."""
    wanted = max(LEAST_BINS, -(-rows // BIN_ROWS))
    return min(MOST_BINS, 1 << (wanted - 1).bit_length())


def _binned(
    df: DataFrame, by: Sequence[str], value: str, bins: int | None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the row's ``_bin``, and what marks tables of one row per bin for their join."""
    if bins is None:
        largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        bins = bins_for(largest or 0)
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two, two or more")
    # A sketch of k values misplaces a cut by about 2.3 / k ** 0.9 of the rows.
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"),
                                     F.lit(min(65535, max(200, 4 * bins))))
    # As text: tens of thousands of literals would slow the analysis down.
    shares = F.split(F.lit(" ".join(str(i / bins) for i in range(1, bins))), " ").cast(
        "array<double>")
    cuts = materialize(
        df.groupBy(*by).agg(sketch.alias("_sketch"))
        .select(*by, F.kll_sketch_get_quantile_double("_sketch", shares).alias("_cuts")), "cuts")
    send = F.broadcast if cuts.count() * bins <= MOST_SENT else (lambda table: table)
    joined = df.join(send(cuts), list(by))
    binned = with_count_at_or_below(joined, value, F.col("_cuts"), bins - 1, "_bin")
    return binned.drop("_cuts"), send


def _sums(weights: Mapping[str, str], prefix: str = "") -> list[Column]:
    return [F.expr(f"sum({w}) AS {prefix}{n}") for n, w in weights.items()]


def _bin_offsets(
    binned: DataFrame, by: Sequence[str], weights: Mapping[str, str], descending: bool
) -> DataFrame:
    """Per bin and weight: the amount in the bin, before the bin and in the whole group."""
    totals = binned.groupBy(*by, "_bin").agg(*_sums(weights, "_in_"))
    group = f"PARTITION BY {', '.join(by)}"
    earlier = (f"{group} ORDER BY _bin {'DESC' if descending else 'ASC'} "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return totals.selectExpr(
        *by, "_bin", *[f"_in_{n}" for n in weights],
        *[f"coalesce(sum(_in_{n}) OVER ({earlier}), 0) AS _off_{n}" for n in weights],
        *[f"sum(_in_{n}) OVER ({group}) AS total_{n}" for n in weights])


def _within_bins(
    binned: DataFrame,
    offsets: DataFrame,
    by: Sequence[str],
    value: str,
    weights: Mapping[str, str],
    descending: bool,
    send: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    distinct = binned.groupBy(*by, "_bin", value).agg(*_sums(weights))
    earlier = (f"PARTITION BY {', '.join(by)}, _bin ORDER BY {value} "
               f"{'DESC' if descending else 'ASC'} "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    local = [f"coalesce(sum({n}) OVER ({earlier}), 0) AS _local_{n}" for n in weights]
    return (distinct.selectExpr("*", *local)
            .join(send(offsets), [*by, "_bin"])
            .selectExpr(*by, value, *weights,
                        *[f"_off_{n} + _local_{n} AS before_{n}" for n in weights],
                        *[f"total_{n}" for n in weights]))


def ordered_prefix(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weights: Mapping[str, str],
    descending: bool = False,
    bins: int | None = None,
) -> DataFrame:
    """One row per group and distinct value with the exact weight at and before the value.

    ``weights`` are SQL expressions. Columns: by.., value, and per weight n: ``n``, ``before_n``,
    ``total_n``. NULL and NaN values are left out. ``bins`` a group, a power of two, follow from the
    rows if not given; they decide how many tasks share a group, never the result.
    """
    binned, send = _binned(_known(df, value), by, value, bins)
    offsets = _bin_offsets(binned, by, weights, descending)
    return _within_bins(binned, offsets, by, value, weights, descending, send)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    weights: Mapping[str, str] | None = None,
    bins: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group: by.., weight, prob, quantile.

    Each weight is a 0/1 expression naming a subset of the rows, so the quantiles of many
    overlapping subsets (for example all training folds) come from one ordering pass. Only the
    bins that hold a wanted position are shuffled.
    """
    weights = weights or {"all": "1"}
    binned, send = _binned(_known(df, value), by, value, bins)
    offsets = _bin_offsets(binned, by, weights, descending=False)

    def spot(n: str, prob: float) -> str:
        return f"(total_{n} - 1) * {float(prob)!r}D"

    def holds(position: str, before: str, here: str) -> str:
        return f"({here} > 0 AND {before} <= {position} AND {position} < {before} + {here})"

    ends = [(n, f"{end}({spot(n, prob)})")
            for n in weights for prob in probs for end in ("floor", "ceil")]
    offsets = offsets.filter(
        " OR ".join(holds(position, f"_off_{n}", f"_in_{n}") for n, position in ends))
    needed = binned.join(send(offsets.select(*by, "_bin")), [*by, "_bin"], "left_semi")
    rows = _within_bins(needed, offsets, by, value, weights, False, send)

    picks, quantiles = [], []
    for n in weights:
        for i, prob in enumerate(probs):
            at = spot(n, prob)
            for end in ("floor", "ceil"):
                held = holds(f"{end}({at})", f"before_{n}", n)
                picks.append(f"max({value}) FILTER (WHERE {held}) AS _{end}_{n}_{i}")
            picks.append(f"max({at} - floor({at})) FILTER (WHERE {n} > 0) AS _part_{n}_{i}")
            low, high = f"_floor_{n}_{i}", f"_ceil_{n}_{i}"
            quantiles.append(f"named_struct('weight', '{n}', 'prob', {float(prob)!r}D, "
                             f"'quantile', {low} + ({high} - {low}) * _part_{n}_{i})")
    return (rows.groupBy(*by).agg(*[F.expr(p) for p in picks])
            .selectExpr(*by, f"inline(array({', '.join(quantiles)}))"))


def ordered_bits(value: str) -> str:
    """SQL for a BIGINT that orders as the double expression ``value`` does, NULL for NaN.

    The bits of the double's size, negative for negative values. Scaling by powers of two is exact,
    so equal numbers, and only those, share a result; both zeros are 0.
    """
    size = f"abs({value})"
    guess = f"floor(log2({size}))"
    # The logarithm may be off by one beside a power of two, at 1.8e308 beyond the last one.
    exponent = (f"({guess} + CASE WHEN {size} < pow(2D, {guess}) THEN -1 "
                f"WHEN {guess} < 1023 AND {size} >= pow(2D, {guess} + 1) THEN 1 ELSE 0 END)")
    normal = (f"(CAST({exponent} AS BIGINT) + 1022) * {2 ** 52}L "
              f"+ CAST({size} / pow(2D, {exponent}) * {2 ** 52}D AS BIGINT)")
    tiny = f"CAST({size} * {2.0 ** 537!r}D * {2.0 ** 537!r}D AS BIGINT)"
    bits = (f"CASE WHEN isnan({value}) THEN NULL WHEN {size} = double('Infinity') "
            f"THEN {2047 * 2 ** 52}L WHEN {size} < {2.0 ** -1022!r}D THEN {tiny} ELSE {normal} END")
    return f"(CASE WHEN {value} < 0 THEN -1L ELSE 1L END * {bits})"


def _from_bits(bits: int) -> float:
    size = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -size if bits < 0 else size


def _cell_of(bits: str, ranges: Sequence[tuple[int, int, int]]) -> str:
    """SQL for the first value of the cell that holds ``bits``; NULL outside the ranges."""
    arms = " ".join(f"WHEN {bits} BETWEEN {low}L AND {high}L THEN {low}L + ({bits} - {low}L) "
                    f"div {width}L * {width}L" for low, high, width in ranges)
    return f"CASE {arms} END" if arms else "CAST(NULL AS BIGINT)"


def counted_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    weights: Mapping[str, str] | None = None,
) -> dict[tuple[str, str, float], float]:
    """Exact interpolated quantiles of columns: (column, weight, prob) -> value.

    No value is sorted or shuffled. A round counts the rows of all columns and weights in 2,048
    cells per range of ordered bits, in one scan; ranges are then narrowed to the cells that hold a
    wanted position, between the least and greatest value found there, until a cell holds one
    value: two rounds for few values, at most six. What is shuffled and reaches the driver is one row
    per cell, at most 2,048 for each of the places still sought. Weights are 0/1 expressions.
    NULL and NaN are left out; a subset without values has no entry. ``df`` is read once.
    """
    if not columns:
        return {}
    weights = weights or {"all": "1"}
    names = list(weights)
    # Values are bounded by 2047 * 2**52 on both sides; the first ranges cover them all.
    span = 2 ** 63 - 2 ** 52
    width = 2 ** (64 - CELL_BITS)
    first = [(-span, -1, width), (0, span, width)]
    # Stored once: rounds then read whole numbers only.
    bits = materialize(df.selectExpr(
        *[f"{ordered_bits(f'CAST(`{c}` AS DOUBLE)')} AS b{i}" for i, c in enumerate(columns)],
        *[f"CAST({w} AS BIGINT) AS w{j}" for j, w in enumerate(weights.values())]), "bits")
    ranges: dict[int, list[tuple[int, int, int]]] = {i: first for i in range(len(columns))}
    base: dict[tuple[int, int], list[int]] = {
        (i, low): [0] * len(names) for i in ranges for low, *_ in first}
    totals: dict[int, list[int]] = {}
    wanted: dict[int, set[tuple[int, int]]] = {}
    found: dict[tuple[int, int, int], int] = {}
    while ranges:
        pairs = ", ".join(f"named_struct('i', {i}, 'bits', b{i}, 'cell', {_cell_of(f'b{i}', r)})"
                          for i, r in ranges.items())
        cells = (bits.selectExpr(*[f"w{j}" for j in range(len(names))], f"inline(array({pairs}))")
                 .filter("cell IS NOT NULL").groupBy("i", "cell")
                 .agg(*[F.expr(f"sum(w{j}) AS w{j}") for j in range(len(names))],
                      F.min("bits").alias("low"), F.max("bits").alias("high"))
                 .collect())
        by_column: dict[int, list] = {i: [] for i in ranges}
        for r in sorted(cells, key=lambda r: (r["i"], r["cell"])):
            by_column[r["i"]].append(r)
        if not totals:
            for i, rows in by_column.items():
                totals[i] = [sum(r[f"w{j}"] for r in rows) for j in range(len(names))]
                # The first two ranges join up: what lies below zero comes before the rest.
                base[i, 0] = [sum(r[f"w{j}"] for r in rows if r["cell"] < 0)
                              for j in range(len(names))]
                wanted[i] = {(j, end((n - 1) * p)) for j, n in enumerate(totals[i]) if n
                             for p in probs for end in (math.floor, math.ceil)}
        following: dict[int, list[tuple[int, int, int]]] = {}
        for i, rows in by_column.items():
            for low, high, _ in ranges[i]:
                before = list(base[i, low])
                for r in (r for r in rows if low <= r["cell"] <= high):
                    here = [r[f"w{j}"] for j in range(len(names))]
                    held = [(j, at) for j, at in wanted[i]
                            if (i, j, at) not in found and before[j] <= at < before[j] + here[j]]
                    if held and r["low"] == r["high"]:
                        found.update({(i, j, at): r["low"] for j, at in held})
                    elif held:
                        base[i, r["low"]] = list(before)
                        step = max(1, -(-(r["high"] - r["low"] + 1) // 2 ** CELL_BITS))
                        following.setdefault(i, []).append((r["low"], r["high"], step))
                    before = [b + n for b, n in zip(before, here)]
        ranges = following
    drop(bits)

    quantiles = {}
    for i, c in enumerate(columns):
        for j, name in enumerate(names):
            for p in probs if totals[i][j] else ():
                at = (totals[i][j] - 1) * p
                low, high = (_from_bits(found[i, j, end(at)]) for end in (math.floor, math.ceil))
                part = at - math.floor(at)
                quantiles[c, name, p] = low + (high - low) * part if high != low else low
    return quantiles


def approximate_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """One-pass sketch quantiles in the same shape, for profiles that need no exact answer."""
    listed = ", ".join(f"{float(p)!r}D" for p in probs)
    sketch = F.expr(f"percentile_approx(`{value}`, array({listed}), {accuracy}) AS _q")
    return (_known(df, value).groupBy(*by).agg(sketch)
            .selectExpr(*by, "'all' AS weight",
                        f"inline(arrays_zip(array({listed}), _q)) AS (prob, quantile)"))
