"""Customers and monthly usage derived from a star schema of customers, orders and lines.

Orders of 1995..2000 form six yearly periods; a customer without an order in 2001 has churned.
Both tables are keyed by customer and built by one aggregation per customer, so what follows
(windows, feature aggregates, the join) needs no exchange beyond the ones made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.sources.scratch import materialize

# Window, outcome year, category names by source code.
FIRST_YEAR = 1995
PERIODS = 6
OUTCOME_YEAR = FIRST_YEAR + PERIODS
CITY_BY_CODE = (
    "Mumbai", "Delhi", "Bengaluru", "Hyderabad", "Pune",
    "Jaipur", "Indore", "Lucknow", "Patna", "Bhopal",
)
PLAN_BY_SEGMENT = {
    "AUTOMOBILE": "Jio 299",
    "BUILDING": "Airtel 349",
    "FURNITURE": "Vi 399",
    "HOUSEHOLD": "Hotstar Mobile",
    "MACHINERY": "OTT Combo 499",
}
CAP_BY_REGION = (2.0, 6.0, 12.0, 25.0, 50.0)
CONTRACT_BY_STATUS = {"P": "Monthly", "O": "Quarterly"}
URGENT = "1-URGENT"
NO_RECHARGE_DAYS = 45.0


# Declared columns, so that opening a table reads no footers and only these columns exist.
SOURCE_COLUMNS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE",
    "events": "event_id BIGINT, user_id BIGINT, value DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, first_year: int, end_year: int) -> DataFrame:
    """Orders of the years [first_year, end_year); the date range reaches the scan."""
    return table(spark, sf_dir, "orders").filter(
        f"o_orderdate >= {_year_start(first_year)} AND o_orderdate < {_year_start(end_year)}")


def _year_start(year: int) -> str:
    return f"TIMESTAMP_NTZ'{year}-01-01 00:00:00'"


def _case(value: str, names: dict[str, str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in names.items())
    return f"CASE {value} {arms} ELSE {otherwise} END"


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = f"o_orderdate < {_year_start(OUTCOME_YEAR)}"
    urgent = f"{observed} AND o_orderpriority = '{URGENT}'"
    return (_orders(spark, sf_dir, FIRST_YEAR, OUTCOME_YEAR + 1)
            .groupBy("o_custkey")
            .agg(F.expr(f"min(CASE WHEN {urgent} THEN year(o_orderdate) * 12 "
                        "+ month(o_orderdate) END) AS first_urgent_month"),
                 F.expr(f"count_if({urgent}) AS urgent_orders"),
                 F.expr("max_by(o_orderstatus, struct(o_orderdate, o_orderkey)) "
                        f"FILTER (WHERE {observed}) AS last_status"),
                 F.expr(f"count_if(NOT ({observed})) AS later_orders"))
            .withColumnRenamed("o_custkey", "customer_id"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the churn label."""
    base = (table(spark, sf_dir, "customer")
            .join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"),
                  "c_nationkey")
            .withColumnRenamed("c_custkey", "customer_id"))
    first_month_after = OUTCOME_YEAR * 12 + 1
    cities = ", ".join(f"'{c}'" for c in CITY_BY_CODE)
    caps = ", ".join(f"{c}D" for c in CAP_BY_REGION)
    return (base.join(_order_facts(spark, sf_dir), "customer_id", "left")
            .selectExpr(
                "customer_id",
                f"get(array({cities}), c_nationkey % 10) AS city",
                f"{_case('c_mktsegment', PLAN_BY_SEGMENT)} AS plan_name",
                "CASE WHEN c_acctbal < 0 THEN 'Manual Recharge' "
                "WHEN c_acctbal < 5000 THEN 'Card Autopay' ELSE 'UPI Autopay' END "
                "AS autopay_type",
                f"coalesce({first_month_after} - first_urgent_month, 1) AS tenure_months",
                "CAST(coalesce(urgent_orders, 0) AS INT) AS support_tickets",
                f"{_case('last_status', CONTRACT_BY_STATUS, repr('Annual'))} AS contract_type",
                f"get(array({caps}), n_regionkey) AS data_cap_gb",
                "IF(coalesce(later_orders, 0) = 0, 1, 0) AS churn"))


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines reduced to one row per order, so joining orders never repeats an order."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.expr("sum(l_quantity) AS quantity"), F.expr("count(1) AS lines"))
            .withColumnRenamed("l_orderkey", "o_orderkey"))


def _period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per customer: the measures of each period side by side."""
    orders = (_orders(spark, sf_dir, FIRST_YEAR, OUTCOME_YEAR)
              .join(_line_facts(spark, sf_dir), "o_orderkey", "left")
              .selectExpr("o_custkey AS customer_id",
                          f"year(o_orderdate) - {FIRST_YEAR - 1} AS month_index",
                          "o_orderdate", "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
                          "quantity", "lines"))
    measures = []
    for k in range(1, PERIODS + 1):
        here = f"FILTER (WHERE month_index = {k})"
        measures += [f"sum(quantity) {here} AS quantity_{k}", f"sum(lines) {here} AS lines_{k}",
                     f"max(o_orderdate) {here} AS last_{k}",
                     f"sum(amount) {here} AS amount_{k}"]
    return orders.groupBy("customer_id").agg(*[F.expr(m) for m in measures])


def _period_row(k: int) -> str:
    idle = f"datediff(DATE'{FIRST_YEAR + k - 1}-12-31', to_date(last_{k}))"
    return ("named_struct("
            f"'month_index', {k}, "
            f"'data_gb', coalesce(quantity_{k}, 0D) / 10, "
            f"'calls_count', CAST(coalesce(lines_{k}, 0) AS INT), "
            f"'days_since_recharge', "
            f"coalesce(round({idle} * 45 / 365, 2), {NO_RECHARGE_DAYS}D), "
            f"'recharge_amount_inr', coalesce(CAST(amount_{k} AS DOUBLE), 0D), "
            f"'observed', last_{k} IS NOT NULL)")


def usage(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """The monthly panel: six rows per customer, or only the periods with orders."""
    facts = _period_facts(spark, sf_dir)
    if dense:
        ids = table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer_id")
        facts = ids.join(facts, "customer_id", "left")
    rows = ", ".join(_period_row(k) for k in range(1, PERIODS + 1))
    panel = facts.selectExpr("customer_id", f"inline(array({rows}))")
    if not dense:
        panel = panel.filter("observed")
    return panel.drop("observed")


def period_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """One stored frame per period: orders are read and grouped once, each frame is a folder."""
    yearly = (_orders(spark, sf_dir, FIRST_YEAR, OUTCOME_YEAR)
              .groupBy("o_custkey", F.expr(f"year(o_orderdate) - {FIRST_YEAR - 1}")
                       .alias("month_index"))
              .agg(F.expr("count(1) AS recharges"),
                   F.expr("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) "
                          "AS recharge_amount_inr"))
              .withColumnRenamed("o_custkey", "customer_id"))
    stored = materialize(yearly, "periods", ("month_index",))
    return [stored.filter(F.col("month_index") == k) for k in range(1, PERIODS + 1)]
