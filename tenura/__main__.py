"""Run everything: ``python -m tenura --customers .. --usage .. --out ..`` (or spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tenura.operators.reports import headline, metrics_report
from tenura.plans.workflow import run_all
from tenura.sources import scratch


def main() -> None:
    parser = argparse.ArgumentParser(prog="tenura", description=__doc__)
    parser.add_argument("--customers", required=True, help="customers table, .csv or Parquet")
    parser.add_argument("--usage", required=True, help="monthly usage table, .csv or Parquet")
    parser.add_argument("--out", required=True, help="folder for features, reports and model")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tenura").getOrCreate()
    run = run_all(spark, args.customers, args.usage, args.out)
    headline(metrics_report(run.report)).show(truncate=False, vertical=True)
    scratch.clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
