"""Behaviour features kept up to date period by period, without reading earlier periods.

A customer's state is one row: sums, counts and maxima of what the features are made of, and the last
two rows of the panel, which the next row's lag and rolling frames reach back to. New rows and states
are shuffled by customer once; windows, aggregate and merge then run within that partitioning, so an
update costs the new rows and the states, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tenura import fixed_values as fv
from tenura.operators import panel
from tenura.sources.scratch import materialize

KEY, ORDER = "customer_id", "month_index"
_ROW = "struct<month_index:int,data_gb:double,days_since_recharge:double>"
# What is added up over the rows of a customer, and what is counted.
_SUMS = {
    "sum_data": "data_gb",
    "sum_calls": "CAST(calls_count AS DOUBLE)",
    "sum_days": "days_since_recharge",
    "sum_amount": "recharge_amount_inr",
    "sum_rolling": "rolling_3m_data_gb",
    "sum_delta": "IF(month_index = 1, 0D, data_gb - prev_data_gb)",
    "sum_x": "IF(data_gb IS NULL, NULL, CAST(month_index AS DOUBLE))",
    "sum_xx": "IF(data_gb IS NULL, NULL, CAST(month_index AS DOUBLE) * month_index)",
    "sum_xy": "month_index * data_gb",
}
_COUNTS = {
    "n_data": "data_gb IS NOT NULL",
    "n_calls": "calls_count IS NOT NULL",
    "n_days": "days_since_recharge IS NOT NULL",
    "n_amount": "recharge_amount_inr IS NOT NULL",
    "n_rolling": "rolling_3m_data_gb IS NOT NULL",
    "n_delta": "month_index = 1 OR data_gb - prev_data_gb IS NOT NULL",
    "recent": f"days_since_recharge <= {fv.RECENT_RECHARGE_DAYS}",
    "increases": "month_index >= 2 AND data_gb > prev_data_gb",
}
_MAXIMA = {
    "max_days": "days_since_recharge",
    "max_rolling_days": "rolling_3m_recharge_recency",
}
STATE = ", ".join([f"{KEY} bigint", *[f"{n} double" for n in _SUMS],
                   *[f"{n} bigint" for n in _COUNTS], *[f"{n} double" for n in _MAXIMA],
                   f"last array<{_ROW}>"])


def empty_state(spark: SparkSession) -> DataFrame:
    """The state before the first period: no customers."""
    return spark.createDataFrame([], STATE)


def _here() -> Column:
    return F.struct(F.col(ORDER).cast("int").alias(ORDER),
                    F.col("data_gb").cast("double").alias("data_gb"),
                    F.col("days_since_recharge").cast("double").alias("days_since_recharge"))


def update(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state after ``rows`` of the panel, stored; one exchange, and only ``rows`` are read.

    ``rows`` may hold several periods of a customer, but none that isn't later than all the customer
    had before: such rows, and rows without a period, raise an error with the number of their customers.
    Customers without new rows keep their state, new customers begin one. Rows without a customer
    make one customer of their own, as in the full computation.
    """
    measures = [KEY, ORDER, "data_gb", "calls_count", "days_since_recharge", "recharge_amount_inr"]
    sums = [*_SUMS, *_COUNTS, *_MAXIMA]
    # The sums travel on the later of the two carried rows.
    carried = state.select(KEY, F.struct(*sums).alias("_sums"),
                           F.posexplode("last").alias("_pos", "_row")).select(
        KEY, "_row.*", F.when(F.col("_pos") == 0, F.col("_sums")).alias("_old"),
        F.lit(True).alias("_carried"))
    extended = rows.select(*measures, F.lit(False).alias("_carried")).unionByName(
        carried, allowMissingColumns=True)
    windowed = panel.with_windows(extended, bounded=True)
    before = F.lag(_here()).over(Window.partitionBy(KEY).orderBy(ORDER))
    windowed = windowed.withColumn("_last", F.array_compact(F.array(_here(), before)))
    new = "FILTER (WHERE NOT _carried)"
    merged = windowed.groupBy(KEY).agg(
        *[F.expr(f"coalesce(any_value(_old, true).{n}, 0D) + coalesce(sum({e}) {new}, 0D) AS {n}")
          for n, e in _SUMS.items()],
        *[F.expr(f"coalesce(any_value(_old, true).{n}, 0L) + count_if({e}) {new} AS {n}")
          for n, e in _COUNTS.items()],
        *[F.expr(f"greatest(any_value(_old, true).{n}, CAST(max({e}) {new} AS DOUBLE)) AS {n}")
          for n, e in _MAXIMA.items()],
        F.expr("max_by(_last, month_index) AS last"),
        F.expr(f"count_if(month_index IS NULL) > 0 OR coalesce(min(month_index) {new} "
               "<= max(month_index) FILTER (WHERE _carried), false) AS _late"))
    seen = Observation()
    checked = merged.observe(seen, F.count_if("_late").alias("late")).drop("_late")
    stored = materialize(checked, "panel-state")
    late = seen.get.get("late", 0)
    if late:
        raise ValueError(f"{late} customers have rows that aren't later than their state")
    return stored


def behaviour(state: DataFrame, trend: bool = False) -> DataFrame:
    """The behaviour features of ``panel.customer_behaviour`` from the states, without a shuffle."""
    def mean(total: str, n: str, name: str) -> str:
        return f"{total} / nullif({n}, 0) AS {name}"

    columns = [
        KEY,
        mean("sum_data", "n_data", "avg_data_gb"),
        mean("sum_calls", "n_calls", "avg_calls"),
        mean("sum_days", "n_days", "avg_days_since_recharge"),
        "max_days AS max_days_since_recharge",
        mean("sum_amount", "n_amount", "avg_recharge_amount_inr"),
        "recent AS recharge_frequency",
        mean("sum_rolling", "n_rolling", "avg_rolling_3m_data_gb"),
        "increases AS usage_increase_months",
        mean("sum_delta", "n_delta", "avg_monthly_data_delta"),
        "max_rolling_days AS max_rolling_recharge_recency",
    ]
    if trend:
        columns.append("(n_data * sum_xy - sum_x * sum_data) "
                       "/ nullif(n_data * sum_xx - sum_x * sum_x, 0) AS data_usage_trend")
    return state.selectExpr(*columns)
