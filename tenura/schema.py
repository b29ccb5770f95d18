"""Declared table schemas, the model's column split and the run parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenura import fixed_values as fv

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("city", T.StringType(), False),
    T.StructField("plan_name", T.StringType(), False),
    T.StructField("autopay_type", T.StringType(), False),
    T.StructField("tenure_months", T.IntegerType(), False),
    T.StructField("support_tickets", T.IntegerType(), False),
    T.StructField("contract_type", T.StringType(), False),
    T.StructField("data_cap_gb", T.DoubleType(), False),
    T.StructField("churn", T.IntegerType(), False),
])
CUSTOMERS_KEY = ("customer_id",)

USAGE = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("month_index", T.IntegerType(), False),
    T.StructField("data_gb", T.DoubleType(), False),
    T.StructField("calls_count", T.IntegerType(), False),
    T.StructField("days_since_recharge", T.DoubleType(), False),
    T.StructField("recharge_amount_inr", T.DoubleType(), False),
])
USAGE_KEY = ("customer_id", "month_index")

KEY = "customer_id"
LABEL = "churn"


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the string columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


@dataclass(frozen=True)
class Economics:
    """What a retention offer costs and what a saved customer is worth."""

    monthly_margin: float = fv.MONTHLY_MARGIN_INR
    intervention_cost: float = fv.RETENTION_COST_INR
    save_probability: float = fv.SAVE_PROBABILITY


@dataclass(frozen=True)
class RunParams:
    """Parameters of a training run."""

    pipeline_version: str = fv.PIPELINE_VERSION
    seed: int = fv.SEED
    test_share: float = fv.TEST_SHARE
    validation_share: float = fv.VALIDATION_SHARE
    folds: int = fv.CV_FOLDS
    economics: Economics = Economics()
    threshold_start: float = fv.THRESHOLD_START
    threshold_end: float = fv.THRESHOLD_END
    threshold_step: float = fv.THRESHOLD_STEP
    forest_depth: int = fv.FOREST_DEPTH
