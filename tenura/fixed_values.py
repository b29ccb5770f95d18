"""Values that results depend on: names, bounds, weights, texts and defaults.

Everything in this module is a fixed value; logic lives elsewhere.
"""

# City groups.
TIER_1_CITIES = ("Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Pune")
TIER_2_CITIES = ("Jaipur", "Lucknow", "Indore")
OTHER_TIER = 3

# Tenure bucket upper bounds (inclusive) and the open top bucket.
TENURE_BUCKETS = ((6, "0-6"), (12, "7-12"), (24, "13-24"), (48, "25-48"))
TENURE_TOP_BUCKET = "49-72"
TENURE_EDGES = (0, 6, 12, 24, 48, 72)

# Recent-recharge limit in days, rolling frame in rows.
RECENT_RECHARGE_DAYS = 10
ROLLING_ROWS = 3

# Monthly list price per plan.
PLAN_PRICES = {
    "Jio 299": 299,
    "Airtel 349": 349,
    "Vi 399": 399,
    "Hotstar Mobile": 149,
    "OTT Combo 499": 499,
}

# Limits of the monthly usage measures.
USAGE_FLOORS = {"data_gb": 0.2, "calls_count": 0, "recharge_amount_inr": 99.0}
RECHARGE_DAYS_RANGE = (0.1, 45.0)
TENURE_RANGE = (1, 72)
TICKET_RANGE = (0, 10)

# Linear churn scorecard.
SCORECARD_INTERCEPT = -1.45
SCORECARD_SLOPES = {
    "avg_days_since_recharge": 0.055,
    "tenure_months": -0.020,
    "support_tickets": 0.22,
    "avg_data_gb": -0.035,
    "data_usage_trend": -0.45,
}
SCORECARD_FLAGS = (
    ("autopay_type", ("UPI Autopay",), -0.35),
    ("autopay_type", ("Card Autopay",), -0.15),
    ("contract_type", ("Monthly",), 0.55),
    ("contract_type", ("Quarterly",), 0.35),
    ("city", ("Patna", "Bhopal"), 0.12),
    ("plan_name", ("Hotstar Mobile",), 0.15),
)

# Reasons in order of precedence, the fallback, and how many are kept.
REASON_RECHARGE = "Recharge recency is elevated"
REASON_SUPPORT = "Frequent support issues"
REASON_USAGE = "Usage is trending down"
REASON_CONTRACT = "Monthly contract has lower commitment"
REASON_PAYMENT = "Manual recharge creates payment friction"
REASON_FALLBACK = "Risk reflects the combined customer behavior pattern"
REASONS_KEPT = 3
REASON_SUPPORT_TICKETS = 3
REASON_USAGE_DELTA = -0.2

# Feature display names and what each one says.
FEATURE_NAMES = {
    "support_tickets": (
        "Support tickets", "Support-ticket activity is an important model signal."),
    "avg_days_since_recharge": (
        "Recharge recency", "Longer recharge gaps are an important model signal."),
    "max_days_since_recharge": (
        "Maximum recharge gap", "Large recharge gaps are an important model signal."),
    "avg_monthly_data_delta": (
        "Monthly usage change", "Month-to-month usage change is an important model signal."),
    "avg_recharge_amount_inr": (
        "Average recharge amount", "Recharge value is an important model signal."),
    "tenure_months": ("Tenure", "Customer tenure is an important model signal."),
    "avg_data_gb": (
        "Average data usage", "Average data consumption is an important model signal."),
    "avg_rolling_3m_data_gb": (
        "Rolling 3-month data usage", "Recent average data usage is an important model signal."),
    "recharge_frequency": (
        "Recharge frequency", "Recharge activity frequency is an important model signal."),
    "usage_increase_months": (
        "Months with increasing usage", "Positive usage movement is an important model signal."),
    "data_cap_gb": ("Data cap", "Plan data capacity is an important model signal."),
    "avg_calls": ("Average calls", "Calling activity is an important model signal."),
    "max_rolling_recharge_recency": (
        "Rolling recharge recency", "Recent recharge recency is an important model signal."),
}
FEATURE_PREFIXES = {
    "contract_type_": ("Contract", "Contract type is an important model signal."),
    "autopay_type_": ("Payment", "Payment method is an important model signal."),
    "plan_name_": ("Plan", "Plan choice is an important model signal."),
}
FEATURE_FALLBACK = "This feature is an important model signal."

# Scoring record as (name, type, default, lower bound, upper bound).
SCORING_FIELDS = (
    ("city", "string", "Indore", None, None),
    ("city_tier", "int", 2, 1, 3),
    ("plan_name", "string", "Jio 299", None, None),
    ("autopay_type", "string", "UPI Autopay", None, None),
    ("tenure_months", "int", 10, 1, None),
    ("tenure_bucket", "string", "7-12", None, None),
    ("support_tickets", "int", 1, 0, None),
    ("contract_type", "string", "Monthly", None, None),
    ("data_cap_gb", "double", 6.0, 0, None),
    ("avg_data_gb", "double", 4.5, 0, None),
    ("avg_calls", "double", 200.0, 0, None),
    ("avg_days_since_recharge", "double", 8.0, 0, None),
    ("max_days_since_recharge", "double", 14.0, 0, None),
    ("avg_recharge_amount_inr", "double", 300.0, 0, None),
    ("recharge_frequency", "double", 6.0, 0, None),
    ("avg_rolling_3m_data_gb", "double", 4.5, 0, None),
    ("usage_increase_months", "double", 2.0, 0, None),
    ("avg_monthly_data_delta", "double", 0.1, None, None),
    ("max_rolling_recharge_recency", "double", 14.0, 0, None),
)

# Run parameters.
SEED = 42
PIPELINE_VERSION = "2026.10"
TEST_SHARE = 0.20
VALIDATION_SHARE = 0.20
CV_FOLDS = 5
MONTHLY_MARGIN_INR = 300.0
RETENTION_COST_INR = 30.0
SAVE_PROBABILITY = 0.35
THRESHOLD_START = 0.05
THRESHOLD_END = 0.90
THRESHOLD_STEP = 0.01
FOREST_DEPTH = 12
ATTRIBUTION_TOP = 30
DRIVERS_DEFAULT = 10
