"""The customer feature table and what is scored from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions import scalars
from tenura.operators import panel

MODEL_FEATURES = (
    "city", "city_tier", "plan_name", "autopay_type", "tenure_months", "tenure_bucket",
    "support_tickets", "contract_type", "data_cap_gb", "avg_data_gb", "avg_calls",
    "avg_days_since_recharge", "max_days_since_recharge", "avg_recharge_amount_inr",
    "recharge_frequency", "avg_rolling_3m_data_gb", "usage_increase_months",
    "avg_monthly_data_delta", "max_rolling_recharge_recency",
)
FEATURE_COLUMNS = ("customer_id", *MODEL_FEATURES, "churn")


def feature_table(
    customers: DataFrame,
    usage: DataFrame,
    trend: bool = False,
    bounded: bool = True,
) -> DataFrame:
    """Customers with their behaviour features; customers without usage are left out.

    The panel is aggregated before the join, so the join is one row to one row. ``trend`` adds
    data_usage_trend, which the scorecard needs and the model does not. The declared panel has one
    row per customer and period, six at most; with ``bounded=False`` a customer may have any number
    of rows, which are then split over tasks.
    """
    return with_behaviour(customers, panel.customer_behaviour(usage, trend, bounded), trend)


def with_behaviour(customers: DataFrame, behaviour: DataFrame, trend: bool = False) -> DataFrame:
    """The feature table from customers and their behaviour features, one row each."""
    columns = FEATURE_COLUMNS + (("data_usage_trend",) if trend else ())
    return (customers
            .join(behaviour, "customer_id")
            .withColumn("city_tier", scalars.city_tier(F.col("city")))
            .withColumn("tenure_bucket", scalars.tenure_bucket(F.col("tenure_months")))
            .select(*columns))


def scorecard(features: DataFrame) -> DataFrame:
    """Churn probability of the linear scorecard; expects data_usage_trend."""
    return features.withColumn("p", scalars.sigmoid(scalars.scorecard_logit()))
