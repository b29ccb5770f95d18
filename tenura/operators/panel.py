"""Per-customer behaviour from a monthly panel: lag and rolling windows, then one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.functions.scalars import clamp, with_count_at_or_below
from tenura.sources.scratch import materialize

LOOKBACK = fv.ROLLING_ROWS - 1
SAMPLE_PER_RANGE = 32


def _window_columns(w: WindowSpec, value: str, recency: str | None) -> dict[str, Column]:
    frame = w.rowsBetween(-LOOKBACK, 0)
    columns = {
        "prev_data_gb": F.lag(value).over(w),
        "rolling_3m_data_gb": F.avg(value).over(frame),
    }
    if recency is not None:
        columns["rolling_3m_recharge_recency"] = F.avg(recency).over(frame)
    return columns


def with_windows(
    panel: DataFrame,
    key: str = "customer_id",
    order: str = "month_index",
    value: str = "data_gb",
    recency: str | None = "days_since_recharge",
    bounded: bool = False,
    pieces: int | None = None,
) -> DataFrame:
    """Previous value and rolling three-row means for keys of any size: one exchange of the rows.

    The order of (key, order) is cut into ``pieces`` ranges of about equally many rows, by default
    as many as a shuffle has partitions. A range receives the last rows of the two ranges before
    it, so frames at its start are complete: four rows per range travel beside the table's own. A
    key with a third of all rows is met by a third of the ranges. The cuts come from a bounded
    sample and only balance the ranges; the results are exact. Rows of equal (key, order) have no
    defined order; null keys are one key, null orders come first.

    ``bounded`` says that a declared rule bounds a key's rows, as the panel's periods do. All rows
    of a key then meet in one task, and an aggregate or join by key needs no further exchange.
    """
    if bounded:
        w = Window.partitionBy(key).orderBy(order)
        return panel.withColumns(_window_columns(w, value, recency))
    measures = [c for c in (value, recency) if c is not None]
    rows = _with_ranges(panel, key, order, pieces)
    # The rank filter is applied before the exchange as well, so this shuffles 2 rows per range
    # and task.
    last = Window.partitionBy("_range").orderBy(F.desc(key), F.desc(order))
    tails = (rows.select("_range", key, order, *measures)
             .withColumn("_rank", F.row_number().over(last))
             .filter(F.col("_rank") <= LOOKBACK).drop("_rank"))
    # Every range but the first holds its own cut, so two ranges hold the two rows before one.
    carried = (tails.withColumn("_later", F.explode(F.array(
                   *[F.col("_range") + i for i in range(1, LOOKBACK + 1)])))
               .drop("_range").withColumnRenamed("_later", "_range")
               .withColumn("_carried", F.lit(True)))
    extended = (rows.withColumn("_carried", F.lit(False))
                .unionByName(carried, allowMissingColumns=True))
    w = Window.partitionBy(key, "_range").orderBy(order)
    return (extended.withColumns(_window_columns(w, value, recency))
            .filter(~F.col("_carried")).drop("_carried", "_range"))


def _with_ranges(panel: DataFrame, key: str, order: str, pieces: int | None) -> DataFrame:
    """Add ``_range``: how many of the stored cuts are at or below the row's (key, order)."""
    pieces = pieces or int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col(key).alias("k"), F.col(order).alias("o"))
    share = min(1.0, pieces * SAMPLE_PER_RANGE / max(panel.count(), 1))
    sample = panel.select(place.alias("at")).sample(share, 0)
    cuts = sample.agg(F.sort_array(F.collect_list("at")).alias("s")).select(F.expr(
        f"array_distinct(transform(filter(sequence(0, {pieces - 1}), i -> i > 0), "
        f"i -> get(s, CAST(i * CAST(size(s) AS LONG) div {pieces} AS INT)))) AS cuts"))
    # Stored, so that every part of a plan and every repeated task sees the same cuts.
    cuts = materialize(cuts.select(F.expr("filter(cuts, c -> c IS NOT NULL)").alias("cuts")),
                       "cuts")
    size = 1
    while size < pieces:
        size = 2 * size + 1
    placed = panel.withColumn("_at", place)
    return with_count_at_or_below(placed, "_at", cuts.scalar(), size, "_range").drop("_at")


def usage_levels() -> list[Column]:
    """Mean and maximum levels of usage and recharge."""
    return [
        F.expr("avg(data_gb) AS avg_data_gb"),
        F.expr("avg(calls_count) AS avg_calls"),
        F.expr("avg(days_since_recharge) AS avg_days_since_recharge"),
        F.expr("max(days_since_recharge) AS max_days_since_recharge"),
        F.expr("avg(recharge_amount_inr) AS avg_recharge_amount_inr"),
    ]


def recharge_frequency() -> Column:
    """Months with a recent recharge; a missing recency does not count."""
    return F.expr(f"count_if(days_since_recharge <= {fv.RECENT_RECHARGE_DAYS}) "
                  "AS recharge_frequency")


def usage_increase_months() -> Column:
    """Months after the first period with usage strictly above the previous row's."""
    return F.expr("count_if(month_index >= 2 AND data_gb > prev_data_gb) "
                  "AS usage_increase_months")


def avg_monthly_data_delta() -> Column:
    """Mean change to the previous row; period 1 counts as a change of 0."""
    return F.expr("avg(IF(month_index = 1, 0D, data_gb - prev_data_gb)) "
                  "AS avg_monthly_data_delta")


def rolling_levels() -> list[Column]:
    return [
        F.expr("avg(rolling_3m_data_gb) AS avg_rolling_3m_data_gb"),
        F.expr("max(rolling_3m_recharge_recency) AS max_rolling_recharge_recency"),
    ]


def usage_trend() -> Column:
    """Least-squares slope of usage over the period index; NULL for fewer than two periods."""
    return F.expr("regr_slope(data_gb, month_index) AS data_usage_trend")


def customer_behaviour(
    usage: DataFrame, trend: bool = False, bounded: bool = True
) -> DataFrame:
    """One row per customer with the ten behaviour features, and the trend if asked for.

    The declared panel bounds a customer's rows by its periods; ``bounded=False`` takes panels in
    which a customer may have any number of them.
    """
    windowed = with_windows(usage, bounded=bounded)
    rolling_data, rolling_recency = rolling_levels()
    measures = [
        *usage_levels(), recharge_frequency(), rolling_data, usage_increase_months(),
        avg_monthly_data_delta(), rolling_recency,
    ]
    if trend:
        measures.append(usage_trend())
    return windowed.groupBy("customer_id").agg(*measures)


def clamped(usage: DataFrame) -> DataFrame:
    """Limit the usage measures to their admissible ranges."""
    limits = {name: clamp(F.col(name), low=low).cast(usage.schema[name].dataType)
              for name, low in fv.USAGE_FLOORS.items()}
    low, high = fv.RECHARGE_DAYS_RANGE
    limits["days_since_recharge"] = clamp(F.col("days_since_recharge"), low, high)
    return usage.withColumns(limits)


def clamped_customers(customers: DataFrame) -> DataFrame:
    """Limit tenure and support tickets to their admissible ranges."""
    limits = {"tenure_months": fv.TENURE_RANGE, "support_tickets": fv.TICKET_RANGE}
    return customers.withColumns({
        name: clamp(F.col(name), low, high).cast(customers.schema[name].dataType)
        for name, (low, high) in limits.items()})


def union_periods(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of per-period frames into one panel."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def left_join_all(base: DataFrame, frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Extend ``base`` by several frames that hold at most one row per key."""
    for frame in frames:
        base = base.join(frame, key, "left")
    return base
