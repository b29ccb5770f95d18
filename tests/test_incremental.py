"""Features kept period by period against the full computation."""

import random
import re

import pytest

from tenura.operators import incremental, panel
from tenura.plans import catalog
from tenura.sources import binding

SCHEMA = ("customer_id long, month_index int, data_gb double, calls_count int, "
          "days_since_recharge double, recharge_amount_inr double")


@pytest.fixture(scope="module")
def usage(spark):
    """Customers with gaps, late starts, missing measures; one of them has no name."""
    rnd = random.Random(3)

    def maybe(value):
        return None if rnd.random() < 0.2 else value

    rows = [(c, m, maybe(round(rnd.random() * 9, 2)), maybe(rnd.randint(0, 50)),
             maybe(float(rnd.randint(0, 60))), maybe(round(rnd.random() * 300, 2)))
            for c in [None, *range(40)] for m in range(1, 13) if rnd.random() < 0.6]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def table(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def assert_same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    assert dict(got.dtypes) == dict(expected.dtypes)

    def by_key(df):
        return {r["customer_id"]: r.asDict() for r in df.collect()}

    got, expected = by_key(got), by_key(expected)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == pytest.approx(row, abs=1e-9), key


@pytest.mark.parametrize("ends", [range(1, 13), [3, 4, 12], [12]])
def test_periods_one_by_one_equal_the_whole_panel(spark, usage, ends):
    state, start = incremental.empty_state(spark), 0
    for end in ends:
        rows = usage.filter(f"month_index > {start} AND month_index <= {end}")
        state, start = incremental.update(state, rows), end
    assert_same(incremental.behaviour(state, trend=True), panel.customer_behaviour(usage, trend=True))


def test_no_new_rows_change_nothing(spark, usage):
    state = incremental.update(incremental.empty_state(spark), usage)
    again = incremental.update(state, usage.limit(0))
    assert table(again) == table(state)
    none = incremental.update(incremental.empty_state(spark), usage.limit(0))
    assert none.count() == 0 and incremental.behaviour(none, trend=True).count() == 0


def test_rows_that_come_late_are_refused(spark, usage):
    state = incremental.update(incremental.empty_state(spark), usage.filter("month_index <= 6"))
    busy = usage.filter("month_index = 6").count()
    with pytest.raises(ValueError, match=rf"^{busy} customers"):
        incremental.update(state, usage.filter("month_index >= 6"))
    undated = spark.createDataFrame([(1, None, 1.0, 1, 1.0, 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="^1 customers"):
        incremental.update(state, undated)


def test_an_update_reads_the_new_rows_and_the_states_in_one_exchange(spark, usage, monkeypatch):
    state = incremental.update(incremental.empty_state(spark), usage.filter("month_index < 6"))
    plans = []
    keep = incremental.materialize
    monkeypatch.setattr(incremental, "materialize", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    incremental.update(state, usage.filter("month_index = 6"))
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id", plans[0])) == 1
    assert "Join" not in plans[0] and "collect_list" not in plans[0]


def test_query_equals_the_feature_table(spark, small):
    got = catalog.incremental_features(spark, small)
    assert got.columns == catalog.feature_table(spark, small).columns
    assert table(got) == table(catalog.feature_table(spark, small))
    assert got.count() == binding.customers(spark, small).count()
