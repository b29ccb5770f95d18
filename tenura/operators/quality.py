"""Integrity rules of the base tables and validation of scoring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura import fixed_values as fv
from tenura.sources.scratch import materialize


def not_null_violations(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """One row per rule: table, column, number of NULLs. One pass, one aggregate row."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rules = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                      F.col(c).alias("violations")) for c in columns]
    return counts.select(F.inline(F.array(*rules)))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def table_facts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows, columns, label rate, missing cells and rows beyond the first per key value."""

    def missing(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.count_if(c.isNull() | F.isnan(c))
        return F.count_if(c.isNull())

    rows = F.count(F.lit(1))
    cells = sum((missing(f) for f in df.schema.fields), F.lit(0))
    keys = F.count_distinct(key) + F.coalesce(
        F.max(F.when(F.col(key).isNull(), 1).otherwise(0)), F.lit(0))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.avg(label).alias("churn_rate"),
        cells.cast("long").alias("missing_cells"),
        (rows - keys).cast("long").alias("duplicate_customer_ids"))


def fill_absent(df: DataFrame) -> DataFrame:
    """Add scoring columns the table lacks, filled with their defaults; present values stay."""
    added = {name: F.lit(default).cast(kind)
             for name, kind, default, _, _ in fv.SCORING_FIELDS if name not in df.columns}
    return df.withColumns(added) if added else df


def _violations(name: str, kind: str, low: float | None, high: float | None,
                source: T.DataType) -> list[Column]:
    raw = F.col(name)
    rules = [F.when(raw.isNull(), f"{name}:missing")]
    if kind == "string":
        if not isinstance(source, T.StringType):
            rules.append(F.when(raw.isNotNull(), f"{name}:type"))
        return rules
    number = raw.try_cast("double")
    bad_type = number.isNull()
    if kind == "int":
        bad_type = bad_type | F.isnan(number) | (number != F.floor(number))
    rules.append(F.when(raw.isNotNull() & bad_type, f"{name}:type"))
    outside = F.lit(False)
    if low is not None:
        outside = outside | F.isnan(number) | (number < low)
    if high is not None:
        outside = outside | (number > high)
    rules.append(F.when(raw.isNotNull() & ~bad_type & outside, f"{name}:range"))
    return rules


def with_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: the list of broken rules of a scoring row, empty for a good row."""
    rules: list[Column] = []
    for name, kind, _, low, high in fv.SCORING_FIELDS:
        rules += _violations(name, kind, low, high, df.schema[name].dataType)
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def _typed(valid: DataFrame) -> DataFrame:
    return valid.withColumns({name: F.col(name).cast(kind) for name, kind, *_ in fv.SCORING_FIELDS})


def rule_names() -> list[str]:
    """Every rule ``with_violations`` can report, field by field."""
    names = []
    for name, _, _, low, high in fv.SCORING_FIELDS:
        names += [f"{name}:missing", f"{name}:type"]
        names += [f"{name}:range"] if low is not None or high is not None else []
    return names


def store_checked(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid rows, rejected rows with violations, rows per rule) of a batch table in one pass.

    The rows are checked, counted and written once, in folders of valid and of rejected rows, so
    either side reads its own folder. The counts are taken while the rows are written: one row per
    rule, rules nobody broke with 0. A row that breaks several rules counts for each.
    """
    checked = with_violations(df).withColumn("_valid", F.size("violations") == 0)
    rules = rule_names()
    seen = Observation()
    counted = checked.observe(seen, *[
        F.count_if(F.array_contains("violations", rule)).alias(rule) for rule in rules])
    stored = materialize(counted, "checked", ("_valid",))
    found = seen.get
    counts = df.sparkSession.createDataFrame(
        [(rule, found.get(rule, 0)) for rule in rules], "rule string, rows long")
    valid = _typed(stored.filter(F.col("_valid")).drop("_valid", "violations"))
    return valid, stored.filter(~F.col("_valid")).drop("_valid"), counts


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows under the declared types, rejected rows with their violations).

    Two filters over the same rows, for streams and small requests; ``store_checked`` makes both from
    one pass over a table.
    """
    checked = with_violations(df)
    good = F.size("violations") == 0
    return _typed(checked.filter(good).drop("violations")), checked.filter(~good)
