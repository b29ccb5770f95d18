"""Rule-based reasons for a customer's risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura import fixed_values as fv


def top_reasons(kept: int = fv.REASONS_KEPT) -> Column:
    """The first ``kept`` reasons that hold, in order of precedence, or the fallback alone."""
    rules = (
        (F.col("avg_days_since_recharge") > fv.RECENT_RECHARGE_DAYS, fv.REASON_RECHARGE),
        (F.col("support_tickets") >= fv.REASON_SUPPORT_TICKETS, fv.REASON_SUPPORT),
        (F.col("avg_monthly_data_delta") < fv.REASON_USAGE_DELTA, fv.REASON_USAGE),
        (F.col("contract_type") == "Monthly", fv.REASON_CONTRACT),
        (F.col("autopay_type") == "Manual Recharge", fv.REASON_PAYMENT),
    )
    found = F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))
    return (F.when(F.size(found) == 0, F.array(F.lit(fv.REASON_FALLBACK)))
            .otherwise(F.slice(found, 1, kept)))
