"""Column functions: bucketing, clamping and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura import fixed_values as fv


def city_tier(city: Column) -> Column:
    """1 for the five metros, 2 for three large cities, 3 for the rest and for NULL."""
    return (F.when(city.isin(*fv.TIER_1_CITIES), 1)
            .when(city.isin(*fv.TIER_2_CITIES), 2)
            .otherwise(fv.OTHER_TIER))


def tenure_bucket(months: Column) -> Column:
    """Model bucket of a tenure; anything above the last bound, and NULL, is the top bucket."""
    bucket = F
    for upper, name in fv.TENURE_BUCKETS:
        bucket = bucket.when(months <= upper, name)
    return bucket.otherwise(fv.TENURE_TOP_BUCKET)


def tenure_interval(months: Column) -> Column:
    """Profiling interval of a tenure: right-closed, first edge included, NULL outside."""
    interval = F
    edges = fv.TENURE_EDGES
    for low, high in zip(edges, edges[1:]):
        first = low == edges[0]
        above = (months >= low) if first else (months > low)
        name = f"{'[' if first else '('}{low}, {high}]"
        interval = interval.when(above & (months <= high), name)
    return interval


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to [low, high]; NULL stays NULL."""
    out = value
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(value.isNotNull(), out)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def scorecard_logit() -> Column:
    """The linear scorecard over a feature row that also carries data_usage_trend."""
    terms = [f"{fv.SCORECARD_INTERCEPT}D"]
    terms += [f"{slope}D * {name}" for name, slope in fv.SCORECARD_SLOPES.items()]
    for name, values, weight in fv.SCORECARD_FLAGS:
        listed = ", ".join(f"'{v}'" for v in values)
        terms.append(f"{weight}D * CAST({name} IN ({listed}) AS INT)")
    return F.expr(" + ".join(terms))


def plan_price(plan: Column) -> Column:
    """List price of a plan, NULL for an unknown one."""
    price = F
    for name, amount in fv.PLAN_PRICES.items():
        price = price.when(plan == name, amount)
    return price


def is_number(value: Column) -> Column:
    """False for NULL and NaN. Spark sorts NaN above all numbers, so comparisons need this."""
    return value.isNotNull() & ~F.isnan(value)


def at_or_above(score: Column, threshold: Column | float) -> Column:
    """Inclusive threshold test; a missing or NaN score never passes."""
    return F.coalesce(is_number(score) & (score >= threshold), F.lit(False))


def threshold_grid(start: float, end: float, step: float) -> list[float]:
    """Arithmetic grid with both ends, each point rounded to two digits."""
    points = int((end - start) / step + 1e-9) + 1
    return [round(start + i * step, 2) for i in range(points)]


def with_count_at_or_below(
    df: DataFrame, value: str, bounds: Column, size: int, out: str
) -> DataFrame:
    """Add how many of the ascending ``bounds`` are <= ``value`` (0..size).

    ``bounds`` is an array of ``size`` = 2**k - 1 entries. Each halving step is its own projection,
    so the whole search stays a short generated loop body rather than a scan of the array.
    """
    if size & (size + 1):
        raise ValueError("size must be 2**k - 1")
    df = df.withColumn("_bounds", bounds).withColumn(out, F.lit(0))
    step = (size + 1) // 2
    while step:
        hit = f"get(_bounds, {out} + {step - 1}) <= `{value}`"
        df = df.withColumn(out, F.expr(f"{out} + IF({hit}, {step}, 0)"))
        step //= 2
    return df.drop("_bounds")


def padded(bounds: Sequence[float]) -> tuple[Column, int]:
    """An ascending literal array filled with +inf up to the next 2**k - 1 entries."""
    size = 1
    while size < len(bounds):
        size = 2 * size + 1
    literals = [f"{float(b)!r}D" for b in bounds] + ["double('Infinity')"] * (size - len(bounds))
    return F.expr(f"array({', '.join(literals)})"), size
