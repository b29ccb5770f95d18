"""Churn profiles and the numeric column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.scalars import tenure_interval
from tenura.operators import ordering
from tenura.sources.scratch import materialize

QUARTILES = (0.25, 0.5, 0.75)


def churn_rate_by(df: DataFrame, group: str, label: str = "churn") -> DataFrame:
    """Label rate per group, highest first, ties by group; rows without a group are left out."""
    return (df.filter(F.col(group).isNotNull())
            .groupBy(group).agg(F.avg(label).alias("churn_rate"))
            .orderBy(F.desc("churn_rate"), group))


def churn_rate_by_tenure(df: DataFrame, label: str = "churn") -> DataFrame:
    """Label rate per observed tenure interval."""
    binned = df.withColumn("tenure_interval", tenure_interval(F.col("tenure_months")))
    return churn_rate_by(binned, "tenure_interval", label)


def class_distribution(df: DataFrame, label: str = "churn") -> DataFrame:
    """Rows per class 0 and 1; a class without rows counts 0."""
    return (df.agg(*[F.count(F.when(F.col(label) == k, 1)).alias(f"n{k}") for k in (0, 1)])
            .select(F.inline(F.array(*[
                F.struct(F.lit(k).alias(label), F.col(f"n{k}").alias("customers"))
                for k in (0, 1)]))))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], digits: int = 3, exact: bool = True
) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column, one row per column.

    ``exact=False`` takes the quartiles from a one-pass sketch.
    """
    df = materialize(df.select(*columns), "profile")
    long = ordering.unpivot(df, columns)
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    if exact:
        found = ordering.counted_quantiles(df, columns, QUARTILES)
        rows = [(c, *[found[c, "all", p] for p in QUARTILES])
                for c in columns if (c, "all", QUARTILES[0]) in found]
        names = ", ".join(f"p{round(100 * p)} double" for p in QUARTILES)
        quartiles = df.sparkSession.createDataFrame(rows, f"feature string, {names}")
    else:
        quartiles = (ordering.approximate_quantiles(long, ["feature"], "value", QUARTILES)
                     .groupBy("feature").agg(*[
                         F.max(F.when(F.col("prob") == p, F.col("quantile")))
                         .alias(f"p{round(100 * p)}") for p in QUARTILES]))
    return (moments.join(quartiles, "feature")
            .select("feature", "count",
                    *[F.round(c, digits).alias(c)
                      for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]))
