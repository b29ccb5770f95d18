"""The registered queries as plain SQL over the Parquet tables, written independently of Spark."""

from __future__ import annotations

from tenura import fixed_values as fv

NUMERIC = (
    "city_tier", "tenure_months", "support_tickets", "data_cap_gb", "avg_data_gb", "avg_calls",
    "avg_days_since_recharge", "max_days_since_recharge", "avg_recharge_amount_inr",
    "recharge_frequency", "avg_rolling_3m_data_gb", "usage_increase_months",
    "avg_monthly_data_delta", "max_rolling_recharge_recency",
)
CATEGORICAL = ("city", "plan_name", "autopay_type", "tenure_bucket", "contract_type")
PROFILED = ("customer_id", "tenure_months", "support_tickets", "data_cap_gb", "churn")
SCORECARD_INPUTS = (
    "city", "plan_name", "autopay_type", "tenure_months", "support_tickets", "contract_type",
    "avg_data_gb", "avg_days_since_recharge", "data_usage_trend",
)
MONEY = ("avg_recharge_amount_inr", "recharge_amount_inr")

CUSTOMERS = """
customers AS (
  SELECT c.c_custkey AS customer_id,
         CASE n.n_nationkey % 10 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Bengaluru'
              WHEN 3 THEN 'Hyderabad' WHEN 4 THEN 'Pune' WHEN 5 THEN 'Jaipur' WHEN 6 THEN 'Indore'
              WHEN 7 THEN 'Lucknow' WHEN 8 THEN 'Patna' ELSE 'Bhopal' END AS city,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Jio 299' WHEN 'BUILDING' THEN 'Airtel 349'
              WHEN 'FURNITURE' THEN 'Vi 399' WHEN 'HOUSEHOLD' THEN 'Hotstar Mobile'
              WHEN 'MACHINERY' THEN 'OTT Combo 499' END AS plan_name,
         CASE WHEN c.c_acctbal < 0 THEN 'Manual Recharge' WHEN c.c_acctbal < 5000
              THEN 'Card Autopay' ELSE 'UPI Autopay' END AS autopay_type,
         CAST(coalesce(12 * 2000 + 12 + 1 - u.first_month, 1) AS INTEGER) AS tenure_months,
         CAST(coalesce(u.tickets, 0) AS INTEGER) AS support_tickets,
         CASE l.o_orderstatus WHEN 'P' THEN 'Monthly' WHEN 'O' THEN 'Quarterly'
              ELSE 'Annual' END AS contract_type,
         CAST(CASE n.n_regionkey WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 12 WHEN 3 THEN 25
              WHEN 4 THEN 50 END AS DOUBLE) AS data_cap_gb,
         CASE WHEN later.o_custkey IS NULL THEN 1 ELSE 0 END AS churn
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT o_custkey, min(12 * year(o_orderdate) + month(o_orderdate)) AS first_month,
                    count(*) AS tickets
             FROM orders
             WHERE year(o_orderdate) BETWEEN 1995 AND 2000 AND o_orderpriority = '1-URGENT'
             GROUP BY 1) u ON u.o_custkey = c.c_custkey
  LEFT JOIN (SELECT o_custkey, o_orderstatus,
                    row_number() OVER (PARTITION BY o_custkey
                                       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
             FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000) l
    ON l.o_custkey = c.c_custkey AND l.rn = 1
  LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2001) later
    ON later.o_custkey = c.c_custkey
)"""

PERIODS = """
period_facts AS (
  SELECT o.o_custkey, year(o.o_orderdate) - 1994 AS month_index,
         sum(l.quantity) AS quantity, sum(l.line_count) AS line_count,
         max(o.o_orderdate) AS last_order, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS amount
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS line_count
             FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
  WHERE year(o.o_orderdate) BETWEEN 1995 AND 2000
  GROUP BY 1, 2
)"""


def _panel(name: str, join: str) -> str:
    return f"""
{name} AS (
  SELECT c.c_custkey AS customer_id, CAST(m.month_index AS INTEGER) AS month_index,
         coalesce(f.quantity, 0) / 10 AS data_gb,
         CAST(coalesce(f.line_count, 0) AS INTEGER) AS calls_count,
         coalesce(round(date_diff('day', CAST(f.last_order AS DATE),
                                  make_date(1994 + m.month_index, 12, 31)) * 45 / 365, 2), 45.0)
           AS days_since_recharge,
         coalesce(CAST(f.amount AS DOUBLE), 0.0) AS recharge_amount_inr
  FROM customer c CROSS JOIN generate_series(1, 6) AS m(month_index)
  {join} JOIN period_facts f ON f.o_custkey = c.c_custkey AND f.month_index = m.month_index
)"""


USAGE = PERIODS + "," + _panel("usage_panel", "LEFT")
SPARSE_USAGE = PERIODS + "," + _panel("usage_panel", "INNER")

# Sequences as lists rather than windows, so that the check does not repeat Spark's formulation.
STEPS = """
sequences AS (
  SELECT customer_id, list(month_index ORDER BY month_index) AS ms,
         list(data_gb ORDER BY month_index) AS ds,
         list(days_since_recharge ORDER BY month_index) AS rs
  FROM usage_panel GROUP BY customer_id
),
steps AS (
  SELECT customer_id, ms[i] AS month_index, ds[i] AS data_gb,
         CASE WHEN i > 1 THEN ds[i - 1] END AS prev_data_gb,
         list_avg(ds[greatest(i - 2, 1):i]) AS rolling_3m_data_gb,
         list_avg(rs[greatest(i - 2, 1):i]) AS rolling_3m_recharge_recency
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM sequences)
)"""

FEATURES = f"""{STEPS},
levels AS (
  SELECT customer_id, avg(data_gb) AS avg_data_gb, avg(calls_count) AS avg_calls,
         avg(days_since_recharge) AS avg_days_since_recharge,
         max(days_since_recharge) AS max_days_since_recharge,
         avg(recharge_amount_inr) AS avg_recharge_amount_inr,
         count(*) FILTER (WHERE days_since_recharge <= 10) AS recharge_frequency,
         regr_slope(data_gb, month_index) AS data_usage_trend
  FROM usage_panel GROUP BY customer_id
),
changes AS (
  SELECT customer_id, avg(rolling_3m_data_gb) AS avg_rolling_3m_data_gb,
         max(rolling_3m_recharge_recency) AS max_rolling_recharge_recency,
         count(*) FILTER (WHERE month_index >= 2 AND data_gb > prev_data_gb)
           AS usage_increase_months,
         avg(IF(month_index = 1, 0, data_gb - prev_data_gb)) AS avg_monthly_data_delta
  FROM steps GROUP BY customer_id
),
behaviour AS (SELECT * FROM levels JOIN changes USING (customer_id)),
features AS (
  SELECT c.*, b.* EXCLUDE (customer_id),
         CASE WHEN city IN ('Mumbai', 'Delhi', 'Bengaluru', 'Hyderabad', 'Pune') THEN 1
              WHEN city IN ('Jaipur', 'Lucknow', 'Indore') THEN 2 ELSE 3 END AS city_tier,
         CASE WHEN tenure_months <= 6 THEN '0-6' WHEN tenure_months <= 12 THEN '7-12'
              WHEN tenure_months <= 24 THEN '13-24' WHEN tenure_months <= 48 THEN '25-48'
              ELSE '49-72' END AS tenure_bucket
  FROM customers c JOIN behaviour b ON b.customer_id = c.customer_id
)"""

SCORES = """
logits AS (
  SELECT *, CAST(-1.45 AS DOUBLE) + CAST(0.055 AS DOUBLE) * avg_days_since_recharge
         + CAST(-0.02 AS DOUBLE) * tenure_months + CAST(0.22 AS DOUBLE) * support_tickets
         + CAST(-0.035 AS DOUBLE) * avg_data_gb + CAST(-0.45 AS DOUBLE) * data_usage_trend
         + CASE autopay_type WHEN 'UPI Autopay' THEN CAST(-0.35 AS DOUBLE)
                             WHEN 'Card Autopay' THEN CAST(-0.15 AS DOUBLE) ELSE 0 END
         + CASE contract_type WHEN 'Monthly' THEN CAST(0.55 AS DOUBLE)
                              WHEN 'Quarterly' THEN CAST(0.35 AS DOUBLE) ELSE 0 END
         + CASE WHEN city IN ('Patna', 'Bhopal') THEN CAST(0.12 AS DOUBLE) ELSE 0 END
         + CASE WHEN plan_name = 'Hotstar Mobile' THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS logit
  FROM features
),
scores AS (SELECT *, round(1 / (1 + exp(-logit)), 10) AS p FROM logits)"""

PARTS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY churn
              ORDER BY md5('42:' || customer_id), customer_id) AS r,
         count(*) OVER (PARTITION BY churn) AS n
  FROM customers
),
sized AS (
  SELECT *, round(n * 0.2) AS n_test, round((n - round(n * 0.2)) * 0.2) AS n_validation
  FROM ranked
),
parts AS (
  SELECT customer_id, churn,
         CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_validation THEN 'validation'
              ELSE 'train' END AS split,
         CASE WHEN r > n_test + n_validation THEN
           CAST(floor((r - n_test - n_validation - 1) * 5 / (n - n_test - n_validation))
                AS INTEGER) END AS fold
  FROM sized
)"""

ALL_FEATURES = f"{CUSTOMERS}, {USAGE}, {FEATURES}"
ALL_SCORES = f"{ALL_FEATURES}, {SCORES}"
ALL_PARTS = f"{CUSTOMERS}, {PARTS}"
SCORED_PARTS = (f"{ALL_SCORES}, {PARTS}, scored_parts AS "
                "(SELECT s.*, q.split, q.fold FROM scores s JOIN parts q USING (customer_id))")


def rounded(columns, digits=6, qualifier="") -> str:
    """Rounded columns; adding 0 turns a negative zero into zero."""
    return ", ".join(f"round({qualifier}{c}, {4 if c in MONEY else digits}) + 0 AS {c}"
                     for c in columns)


FEATURE_DOUBLES = (
    "avg_data_gb", "avg_calls", "avg_days_since_recharge", "max_days_since_recharge",
    "avg_recharge_amount_inr", "avg_rolling_3m_data_gb", "avg_monthly_data_delta",
    "max_rolling_recharge_recency",
)
FEATURE_ROW = (
    "customer_id, city, city_tier, plan_name, autopay_type, tenure_months, tenure_bucket, "
    "support_tickets, contract_type, data_cap_gb, recharge_frequency, usage_increase_months, "
    "churn, " + rounded(FEATURE_DOUBLES))


GRID = "SELECT i::DOUBLE / 100::DOUBLE FROM generate_series(5, 90) t(i)"


def _curve(source: str, cost: float = 30.0) -> str:
    """CTE ``curve`` over rows (churn, p) of ``source``."""
    return f"""
grid(threshold) AS ({GRID}),
counted AS (
  SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS targeted,
         count(*) FILTER (WHERE p >= threshold AND churn = 1) AS captured,
         count(*) AS customers, count(*) FILTER (WHERE churn = 1) AS churners
  FROM {source} CROSS JOIN grid GROUP BY threshold
),
curve AS (
  SELECT threshold, targeted AS targeted_customers,
         coalesce(targeted::DOUBLE / nullif(customers, 0), 0) AS targeted_share,
         captured AS captured_churners,
         coalesce(captured::DOUBLE / nullif(churners, 0), 0) AS recall,
         coalesce(captured::DOUBLE / nullif(targeted, 0), 0) AS precision,
         captured * 0.35::DOUBLE * 300::DOUBLE AS gross_expected_value_inr,
         targeted * {cost}::DOUBLE AS intervention_cost_inr,
         captured * 0.35::DOUBLE * 300::DOUBLE - targeted * {cost}::DOUBLE
           AS net_expected_value_inr
  FROM counted
)"""


CURVE_ROW = (
    "threshold, targeted_customers, round(targeted_share, 6) AS targeted_share, "
    "captured_churners, round(recall, 6) AS recall, round(precision, 6) AS precision, "
    "round(gross_expected_value_inr, 4) AS gross_expected_value_inr, "
    "round(intervention_cost_inr, 4) AS intervention_cost_inr, "
    "round(net_expected_value_inr, 4) AS net_expected_value_inr")

CONFUSION = """
    count(*) AS size, avg(churn) AS churn_rate,
    count(*) FILTER (WHERE p >= {t} AND churn = 1) AS tp,
    count(*) FILTER (WHERE p >= {t} AND churn = 0) AS fp,
    count(*) FILTER (WHERE NOT p >= {t} AND churn = 1) AS fn"""
RATES = """
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def _roc_auc(source: str) -> str:
    return f"""(SELECT (sum(mid_rank) FILTER (WHERE churn = 1)
                        - sum(churn) * (sum(churn) + 1) / 2.0::DOUBLE)
                       / (sum(churn) * sum(1 - churn))
                FROM (SELECT churn, rank() OVER (ORDER BY p)
                             + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS mid_rank
                      FROM {source}))"""


def _average_precision(source: str) -> str:
    return f"""(SELECT sum(pos * cum_pos / cum_all::DOUBLE) / sum(pos)
                FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cum_pos,
                             sum(al) OVER (ORDER BY p DESC) AS cum_all
                      FROM (SELECT p, sum(churn)::DOUBLE AS pos, count(*) AS al
                            FROM {source} GROUP BY p)))"""


def _test_report() -> str:
    features = ",".join(f'"{c}"' for c in SCORECARD_INPUTS)
    return f"""WITH {SCORED_PARTS},
validation AS (SELECT * FROM scored_parts WHERE split = 'validation'),
test AS (SELECT * FROM scored_parts WHERE split = 'test'),
{_curve('validation', 45.0)},
best AS (SELECT * FROM curve ORDER BY net_expected_value_inr DESC, threshold LIMIT 1),
measured AS (
  SELECT {CONFUSION.format(t='threshold')}, any_value(threshold) AS threshold,
         any_value(targeted_share) AS targeted_share,
         any_value(captured_churners) AS captured_churners,
         any_value(gross_expected_value_inr) AS gross,
         any_value(intervention_cost_inr) AS cost, any_value(net_expected_value_inr) AS net
  FROM test CROSS JOIN best
),
sizes AS (SELECT count(*) FILTER (WHERE split <> 'test') AS train_rows FROM scored_parts)
SELECT 'Scorecard' AS model_name,
       '2026.10-' || substr(sha256('{{"features":[{features}],"model":"Scorecard",'
         || '"pipeline_version":"2026.10","seed":42,"test_rows":' || size || ',"threshold":'
         || threshold || ',"train_rows":' || train_rows || '}}'), 1, 12) AS model_version,
       'cv_pr_auc_mean' AS selection_metric, size AS test_size,
       round(churn_rate, 6) AS test_churn_rate, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1,
       round({_roc_auc('test')}, 6) AS roc_auc,
       round({_average_precision('test')}, 6) AS pr_auc, threshold AS decision_threshold,
       round(targeted_share, 6) AS targeted_share, captured_churners,
       round(gross, 4) AS gross_expected_value_inr, round(cost, 4) AS intervention_cost_inr,
       round(net, 4) AS net_expected_value_inr
FROM (SELECT *, {RATES} FROM measured CROSS JOIN sizes)"""


def _scaled(columns) -> str:
    stats = ", ".join(
        f"median({c}) FILTER (WHERE split = 'train') AS med_{c}" for c in columns)
    moments = ", ".join(
        f"avg(coalesce({c}, med_{c})) FILTER (WHERE split = 'train') AS mean_{c}, "
        f"stddev_pop(coalesce({c}, med_{c})) FILTER (WHERE split = 'train') AS sd_{c}"
        for c in columns)
    values = ", ".join(
        f"round((coalesce({c}, med_{c}) - mean_{c}) / "
        f"CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END, 6) + 0 AS num__{c}" for c in columns)
    return f"""rows_in_parts AS (
  SELECT f.*, q.split FROM features f JOIN parts q USING (customer_id)),
medians AS (SELECT {stats} FROM rows_in_parts),
moments AS (SELECT {moments} FROM rows_in_parts CROSS JOIN medians)
SELECT customer_id, {values} FROM rows_in_parts CROSS JOIN medians CROSS JOIN moments"""


def _impute_fit() -> str:
    numeric = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(median({c}), 6) + 0 AS median, "
        f"CAST(NULL AS VARCHAR) AS mode FROM train_rows" for c in NUMERIC)
    text = " UNION ALL ".join(
        f"SELECT '{c}', NULL, (SELECT {c} FROM train_rows GROUP BY 1 "
        f"ORDER BY count(*) DESC, 1 LIMIT 1)" for c in CATEGORICAL)
    return f"""WITH {ALL_FEATURES}, {PARTS},
train_rows AS (SELECT f.* FROM features f JOIN parts q USING (customer_id)
               WHERE q.split = 'train')
{numeric} UNION ALL {text}"""


def _rule_violations() -> str:
    texts = ("city", "plan_name", "autopay_type", "tenure_bucket", "contract_type")
    least = {"city_tier": 1, "tenure_months": 1, "support_tickets": 0, "data_cap_gb": 0,
             "avg_data_gb": 0, "avg_calls": 0, "avg_days_since_recharge": 0,
             "max_days_since_recharge": 0, "avg_recharge_amount_inr": 0, "recharge_frequency": 0,
             "avg_rolling_3m_data_gb": 0, "usage_increase_months": 0,
             "max_rolling_recharge_recency": 0}
    rules = []
    for c in (*texts, *least, "avg_monthly_data_delta"):
        rules.append(f"SELECT '{c}:missing' AS rule, count(*) FILTER ({c} IS NULL) AS rows FROM r")
        rules.append(f"SELECT '{c}:type', 0 FROM (SELECT 1)")
    for c, low in least.items():
        above = f" OR {c} > 3" if c == "city_tier" else ""
        rules.append(f"SELECT '{c}:range', count(*) FILTER ({c} < {low}{above}) FROM r")
    return f"""WITH {CUSTOMERS}, {SPARSE_USAGE}, {FEATURES},
r AS (SELECT * REPLACE (tenure_months - 12 AS tenure_months) FROM features)
{' UNION ALL '.join(rules)}"""


def _profile() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 3) AS mean,
        round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 3) AS p25,
        round(quantile_cont({c}::DOUBLE, 0.5), 3) AS p50,
        round(quantile_cont({c}::DOUBLE, 0.75), 3) AS p75, round(max({c})::DOUBLE, 3) AS max
        FROM customers""" for c in PROFILED)


def _display_case() -> tuple[str, str]:
    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    names = "".join(f" WHEN raw = {quote(k)} THEN {quote(v[0])}"
                    for k, v in fv.FEATURE_NAMES.items())
    texts = "".join(f" WHEN raw = {quote(k)} THEN {quote(v[1])}"
                    for k, v in fv.FEATURE_NAMES.items())
    for prefix, (title, meaning) in fv.FEATURE_PREFIXES.items():
        test = f" WHEN starts_with(raw, '{prefix}') THEN "
        names += f"{test} '{title}: ' || replace(replace(raw, '{prefix}', ''), '_', ' ')"
        texts += f"{test} {quote(meaning)}"
    title = ("array_to_string(list_transform(string_split(replace(raw, '_', ' '), ' '), "
             "lambda w: upper(w[1]) || lower(w[2:])), ' ')")
    return (f"CASE{names} ELSE {title} END",
            f"CASE{texts} ELSE {quote(fv.FEATURE_FALLBACK)} END")


def _driver_names() -> str:
    name, text = _display_case()
    numeric = " UNION ALL ".join(
        f"SELECT 'num__{c}' AS feature, count({c}) AS customers FROM features" for c in NUMERIC)
    values = " UNION ALL ".join(
        f"SELECT 'cat__{c}_' || {c}, count(*) FROM features GROUP BY 1" for c in CATEGORICAL)
    return f"""WITH {ALL_FEATURES}, counted AS ({numeric} UNION ALL {values}),
named AS (SELECT *, replace(replace(feature, 'num__', ''), 'cat__', '') AS raw FROM counted)
SELECT feature, customers, {name} AS display_name, {text} AS interpretation FROM named"""


REASONS = f"""list_filter([
    CASE WHEN avg_days_since_recharge > 10 THEN '{fv.REASON_RECHARGE}' END,
    CASE WHEN support_tickets >= 3 THEN '{fv.REASON_SUPPORT}' END,
    CASE WHEN avg_monthly_data_delta < -0.2 THEN '{fv.REASON_USAGE}' END,
    CASE WHEN contract_type = 'Monthly' THEN '{fv.REASON_CONTRACT}' END,
    CASE WHEN autopay_type = 'Manual Recharge' THEN '{fv.REASON_PAYMENT}' END
  ], lambda x: x IS NOT NULL)"""
TOP_REASONS = (f"CASE WHEN len(reasons) = 0 THEN '{fv.REASON_FALLBACK}' "
               "ELSE array_to_string(reasons[1:3], ' | ') END")


def _attribution(sample: int | None = None) -> str:
    used = "" if sample is None else f"WHERE row_number <= {sample}"
    terms = [(f"num__{c}", f"{c}::DOUBLE", w) for c, w in fv.SCORECARD_SLOPES.items()]
    for c, values, w in fv.SCORECARD_FLAGS:
        listed = ", ".join(f"'{v}'" for v in values)
        terms.append((f"cat__{c}_{'+'.join(values)}",
                      f"CAST({c} IN ({listed}) AS INTEGER)::DOUBLE", w))
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, avg(abs({w}::DOUBLE * (x - m))) AS mean_abs_shap "
        f"FROM (SELECT {x} AS x, avg({x}) OVER () AS m, "
        f"row_number() OVER (ORDER BY customer_id) AS row_number FROM features) {used}"
        for name, x, w in terms)
    return f"""WITH {ALL_FEATURES}
SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap FROM ({parts})
ORDER BY mean_abs_shap DESC, feature LIMIT {fv.ATTRIBUTION_TOP}"""


def _default_fill() -> str:
    present = ("city", "plan_name", "autopay_type", "tenure_months", "support_tickets",
               "contract_type", "data_cap_gb")
    added = []
    for name, kind, default, _, _ in fv.SCORING_FIELDS:
        if name not in present:
            literal = f"'{default}'" if kind == "string" else f"CAST({default} AS {kind})"
            added.append(f"{literal} AS {name}")
    return (f"WITH {CUSTOMERS} SELECT customer_id, {', '.join(present)}, {', '.join(added)} "
            "FROM customers")


def _one_hot() -> str:
    rows = " UNION ALL ".join(
        f"SELECT customer_id, 'cat__{c}_' || {c} AS feature, 1.0::DOUBLE AS value FROM features "
        f"WHERE {c} IN (SELECT {c} FROM features JOIN parts USING (customer_id) "
        f"WHERE split = 'train')" for c in CATEGORICAL)
    return f"WITH {ALL_FEATURES}, {PARTS} {rows}"


def _not_null() -> str:
    rules = [("customers", c) for c in (
        "city", "plan_name", "autopay_type", "tenure_months", "support_tickets",
        "contract_type", "data_cap_gb", "churn")]
    rules += [("customer_monthly_usage", c) for c in (
        "customer_id", "month_index", "data_gb", "calls_count", "days_since_recharge",
        "recharge_amount_inr")]
    source = {"customers": "customers", "customer_monthly_usage": "usage_panel"}
    return f"WITH {CUSTOMERS}, {USAGE} " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {source[t]}" for t, c in rules)


MISSING = "CAST(sum(" + " + ".join(f"({c} IS NULL)::INTEGER" for c in (
    "customer_id", "city", "plan_name", "autopay_type", "tenure_months", "support_tickets",
    "contract_type", "data_cap_gb", "churn")) + ") AS BIGINT)"

GAPS = """orders_with_gaps AS (SELECT o_custkey, o_totalprice,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS pr FROM orders)"""


def _fitted() -> dict[str, str]:
    """What must hold of any fitted model, from the tables alone."""
    learned = {**{f"cv{k}": f"split = 'train' AND fold <> {k}" for k in range(5)},
               "train": "split = 'train'", "final": "split IN ('train', 'validation')"}
    gradient = []
    for name, rows in learned.items():
        gradient += [f"SELECT '{name}' AS fit_set, 'num__{c}' AS feature, 0.0::DOUBLE AS gradient"
                     for c in NUMERIC]
        gradient += [f"SELECT DISTINCT '{name}', 'cat__{c}_' || {c}, 0.0::DOUBLE FROM features "
                     f"JOIN parts USING (customer_id) WHERE {rows}" for c in CATEGORICAL]
    return {
        "standardize_constant": f"""WITH {ALL_PARTS}, t AS (
  SELECT avg(tenure_months) AS m, stddev_pop(tenure_months) AS s FROM customers
  JOIN parts USING (customer_id) WHERE split = 'train')
SELECT customer_id, 0.0::DOUBLE AS num__tenth,
       round((tenure_months - m) / s, 6) AS num__tenure_months FROM customers CROSS JOIN t""",
        "logistic_gradient": f"WITH {ALL_FEATURES}, {PARTS} " + " UNION ALL ".join(gradient),
        "model_facts": """SELECT model, true AS in_range, true AS selection_holds
FROM (VALUES ('LogisticRegression'), ('RandomForest'), ('GradientBoostedTrees')) v(model)""",
        "test_facts": f"""WITH {ALL_PARTS}
SELECT count(*) AS test_size, round(avg(churn), 6) AS test_churn_rate, true AS on_grid,
       true AS in_range, true AS money_adds_up FROM parts WHERE split = 'test'""",
        "scored_facts": f"""WITH {ALL_FEATURES}
SELECT customer_id, {TOP_REASONS} AS top_reasons, true AS decision_holds
FROM (SELECT *, {REASONS} AS reasons FROM features)""",
        "identity_facts": "SELECT 'ok' AS status, true AS same_model, true AS same_version, "
                          "true AS same_threshold",
        "driver_facts": "SELECT 10::BIGINT AS drivers, 10::BIGINT AS top_n, true AS named, "
                        "true AS not_negative",
    }


def statements() -> dict[str, str]:
    """SQL per registered query."""
    windows = f"WITH {USAGE}, {STEPS}"
    levels = ("avg_data_gb", "avg_calls", "avg_days_since_recharge", "max_days_since_recharge",
              "avg_recharge_amount_inr")
    behaviour = f"WITH {CUSTOMERS}, {USAGE}, {FEATURES}"
    scored = f"WITH {ALL_SCORES}"
    curve = f"{scored}, {_curve('scores')} SELECT {CURVE_ROW} FROM curve"
    features = f"WITH {ALL_FEATURES} SELECT {FEATURE_ROW} FROM features"
    confusion = f"""{scored}, counted AS (
  SELECT churn_rate, size, tp, fp, fn, {RATES} FROM (SELECT {CONFUSION.format(t='0.5')}
  FROM scores))
SELECT size, round(churn_rate, 6) AS churn_rate, tp, fp, fn, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM counted"""
    return {
        "feature_table": features,
        "bucketed_features": features,
        "incremental_features": features,
        "feature_view": f"""WITH {ALL_FEATURES}
SELECT plan_name, tenure_bucket, count(*) AS customers,
       round(avg(avg_data_gb), 6) AS avg_data_gb FROM features GROUP BY 1, 2""",
        "io_roundtrip": features,
        "lag_usage": f"""{windows}
SELECT customer_id, month_index, data_gb, prev_data_gb FROM steps""",
        "rolling_usage": f"""{windows}
SELECT customer_id, month_index, round(rolling_3m_data_gb, 6) AS rolling_3m_data_gb
FROM steps""",
        "rolling_recency": f"""{windows}
SELECT customer_id, month_index,
       round(rolling_3m_recharge_recency, 6) AS rolling_3m_recharge_recency FROM steps""",
        "event_windows": """SELECT user_id, event_id, value,
       lag(value) OVER w AS prev_data_gb,
       round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
         AS rolling_3m_data_gb
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
        "customer_usage_agg": f"{behaviour} SELECT customer_id, {rounded(levels)} FROM behaviour",
        "recharge_frequency":
            f"{behaviour} SELECT customer_id, recharge_frequency FROM behaviour",
        "usage_increase":
            f"{behaviour} SELECT customer_id, usage_increase_months FROM behaviour",
        "monthly_delta": f"""WITH {CUSTOMERS}, {SPARSE_USAGE}, {FEATURES}
SELECT customer_id, round(avg_monthly_data_delta, 6) + 0 AS avg_monthly_data_delta
FROM behaviour""",
        "rolling_agg": f"""{behaviour}
SELECT customer_id, round(avg_rolling_3m_data_gb, 6) AS avg_rolling_3m_data_gb,
       round(max_rolling_recharge_recency, 6) AS max_rolling_recharge_recency FROM behaviour""",
        "usage_trend": f"""{behaviour}
SELECT customer_id, round(data_usage_trend, 6) + 0 AS data_usage_trend FROM behaviour""",
        "usage_union": """SELECT o_custkey AS customer_id,
       CAST(year(o_orderdate) - 1994 AS INTEGER) AS month_index, count(*) AS recharges,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 4)
         AS recharge_amount_inr
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2""",
        "usage_left_join": f"""WITH {SPARSE_USAGE}
SELECT c_custkey AS customer_id, round(t.slope, 6) + 0 AS data_usage_trend,
       round(o.recharge_amount_inr, 4) AS recharge_amount_inr, o.recharges
FROM customer
LEFT JOIN (SELECT customer_id, CASE WHEN count(DISTINCT month_index) > 1
                  THEN regr_slope(data_gb, month_index) END AS slope
           FROM usage_panel GROUP BY 1) t ON t.customer_id = c_custkey
LEFT JOIN (SELECT o_custkey, avg(yearly) AS recharge_amount_inr,
                  CAST(sum(n) AS BIGINT) AS recharges
           FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n,
                        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS yearly
                 FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2)
           GROUP BY 1) o ON o.o_custkey = c_custkey""",
        "attribute_merge": f"""WITH {CUSTOMERS}, {SPARSE_USAGE}
SELECT customer_id, city, plan_name, round(u.avg_data_gb, 6) AS avg_data_gb
FROM customers JOIN (SELECT customer_id, avg(data_gb) AS avg_data_gb FROM usage_panel
                     GROUP BY 1) u USING (customer_id)""",
        "plan_price_lookup": f"""WITH {CUSTOMERS}
SELECT customer_id, plan_name, CASE plan_name WHEN 'Jio 299' THEN 299 WHEN 'Airtel 349' THEN 349
       WHEN 'Vi 399' THEN 399 WHEN 'Hotstar Mobile' THEN 149 WHEN 'OTT Combo 499' THEN 499 END
       AS list_price_inr FROM customers""",
        "clamped_usage": f"""WITH {USAGE}
SELECT customer_id, month_index, greatest(data_gb, 0.2::DOUBLE) AS data_gb,
       greatest(calls_count, 0) AS calls_count,
       least(greatest(days_since_recharge, 0.1::DOUBLE), 45::DOUBLE) AS days_since_recharge,
       round(greatest(recharge_amount_inr, 99::DOUBLE), 4) AS recharge_amount_inr
FROM usage_panel""",
        "city_tier": f"WITH {ALL_FEATURES} SELECT customer_id, city, city_tier FROM features",
        "tenure_bucket":
            f"WITH {ALL_FEATURES} SELECT customer_id, tenure_months, tenure_bucket FROM features",
        "not_null_violations": _not_null(),
        "pk_duplicates": """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
        "usage_key_duplicates": f"""WITH {USAGE} SELECT customer_id, month_index, count(*) AS rows
FROM usage_panel GROUP BY 1, 2 HAVING count(*) > 1""",
        "churn_by_plan": f"""WITH {CUSTOMERS}
SELECT plan_name, round(avg(churn), 6) AS churn_rate FROM customers GROUP BY 1""",
        "churn_by_tenure": f"""WITH {CUSTOMERS}, binned AS (
  SELECT churn, CASE WHEN tenure_months < 0 THEN NULL WHEN tenure_months <= 6 THEN '[0, 6]'
    WHEN tenure_months <= 12 THEN '(6, 12]' WHEN tenure_months <= 24 THEN '(12, 24]'
    WHEN tenure_months <= 48 THEN '(24, 48]' WHEN tenure_months <= 72 THEN '(48, 72]' END
    AS tenure_interval FROM customers)
SELECT tenure_interval, round(avg(churn), 6) AS churn_rate FROM binned
WHERE tenure_interval IS NOT NULL GROUP BY 1""",
        "churn_distribution": f"""WITH {CUSTOMERS}
SELECT k.churn, count(c.customer_id) AS customers FROM (VALUES (0), (1)) k(churn)
LEFT JOIN customers c ON c.churn = k.churn GROUP BY 1""",
        "profile_scalars": f"""WITH {CUSTOMERS}
SELECT count(*) AS rows, 9 AS columns, round(avg(churn), 6) AS churn_rate,
       {MISSING} AS missing_cells,
       count(*) - count(DISTINCT customer_id) AS duplicate_customer_ids FROM customers""",
        "profile_scalars_orders": """WITH t AS (
  SELECT o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS pr,
         CAST(o_orderstatus = 'F' AS INTEGER) AS flag FROM orders)
SELECT count(*) AS rows, 4 AS columns, round(avg(flag), 6) AS churn_rate,
       count(*) FILTER (WHERE pr IS NULL) AS missing_cells,
       count(*) - count(DISTINCT o_custkey) AS duplicate_customer_ids FROM t""",
        "numeric_profile": f"WITH {CUSTOMERS} {_profile()}",
        "eda_summary": f"""WITH {CUSTOMERS}, profile AS ({_profile()})
SELECT (SELECT count(*) FROM customers) AS rows, 9 AS columns,
       (SELECT round(avg(churn), 6) FROM customers) AS churn_rate,
       (SELECT {MISSING} FROM customers) AS missing_cells,
       (SELECT count(*) - count(DISTINCT customer_id) FROM customers) AS duplicate_customer_ids,
       feature, count, mean, std, p50 FROM profile""",
        "scorecard": f"""{scored}
SELECT customer_id, round(logit, 6) + 0 AS logit, round(p, 6) AS p FROM scores""",
        "scorecard_decisions": f"""{scored}
SELECT customer_id, 'Scorecard' AS model_name, '2026.10' AS model_version,
       round(p, 4) AS churn_probability, p >= 0.5 AS high_risk,
       0.5::DOUBLE AS decision_threshold, {TOP_REASONS} AS top_reasons
FROM (SELECT *, {REASONS} AS reasons FROM scores)""",
        "roi_curve_histogram": curve,
        "roi_best": f"""{scored}, {_curve('scores', 45.0)}
SELECT {CURVE_ROW} FROM curve ORDER BY curve.net_expected_value_inr DESC, threshold LIMIT 1""",
        "roi_by_plan": f"""{scored}, grid(threshold) AS ({GRID})
SELECT plan_name, threshold, count(*) FILTER (WHERE p >= threshold) AS targeted_customers,
       count(*) FILTER (WHERE p >= threshold AND churn = 1) AS captured_churners
FROM scores CROSS JOIN grid GROUP BY 1, 2""",
        "threshold_metrics": confusion,
        "roc_auc": f"{scored} SELECT round({_roc_auc('scores')}, 6) AS roc_auc",
        "average_precision":
            f"{scored} SELECT round({_average_precision('scores')}, 6) AS pr_auc",
        "split_assignment": f"WITH {ALL_PARTS} SELECT customer_id, churn, split FROM parts",
        "fold_assignment": f"""WITH {ALL_PARTS}
SELECT customer_id, churn, fold FROM parts WHERE split = 'train'""",
        "class_weights": f"""WITH {ALL_PARTS}
SELECT n0 AS negatives, n1 AS positives, round((n0 + n1) / (2.0::DOUBLE * n0), 6)
         AS negative_weight,
       round((n0 + n1) / (2.0::DOUBLE * n1), 6) AS positive_weight,
       round(n0 / n1::DOUBLE, 6) AS scale_pos_weight
FROM (SELECT greatest(count(*) FILTER (WHERE churn = 0), 1) AS n0,
             greatest(count(*) FILTER (WHERE churn = 1), 1) AS n1
      FROM parts WHERE split = 'train')""",
        "impute_fit": _impute_fit(),
        "standardize": f"WITH {ALL_FEATURES}, {PARTS}, {_scaled(NUMERIC)}",
        "one_hot": _one_hot(),
        "validate_inputs": f"""WITH {CUSTOMERS}, {SPARSE_USAGE}, {FEATURES}
SELECT customer_id, 'avg_monthly_data_delta:missing' AS violations FROM features
WHERE avg_monthly_data_delta IS NULL""",
        "rule_violations": _rule_violations(),
        "rejected_rows": f"""WITH {CUSTOMERS}, {SPARSE_USAGE}, {FEATURES},
judged AS (SELECT customer_id, concat_ws(' | ',
    CASE WHEN tenure_months - 12 < 1 THEN 'tenure_months:range' END,
    CASE WHEN avg_monthly_data_delta IS NULL THEN 'avg_monthly_data_delta:missing' END)
    AS violations FROM features)
SELECT customer_id, violations FROM judged WHERE violations <> ''
UNION ALL SELECT NULL, 'valid ' || count(*) FROM judged WHERE violations = ''""",
        "default_fill": _default_fill(),
        "reasons": f"""WITH {ALL_FEATURES}
SELECT customer_id, {TOP_REASONS} AS top_reasons
FROM (SELECT *, {REASONS} AS reasons FROM features)""",
        "driver_names": _driver_names(),
        "scorecard_attribution": _attribution(),
        "roi_report": f"""{scored}, {_curve('scores', 45.0)},
best AS (SELECT threshold AS optimal_threshold FROM curve
         ORDER BY net_expected_value_inr DESC, threshold LIMIT 1)
SELECT 'Scorecard' AS model_name, 300.0::DOUBLE AS monthly_margin_inr,
       45.0::DOUBLE AS intervention_cost_inr_per_customer,
       0.35::DOUBLE AS save_probability_if_targeted, optimal_threshold, {CURVE_ROW}
FROM curve CROSS JOIN best""",
        "scorecard_report": _test_report(),
        "headline_numbers": f"""SELECT test_size, test_churn_rate, roc_auc, pr_auc,
       decision_threshold, captured_churners, targeted_share, gross_expected_value_inr,
       intervention_cost_inr, net_expected_value_inr FROM ({_test_report()})""",
        "clamped_customers": f"""WITH {CUSTOMERS}
SELECT customer_id, least(greatest(tenure_months, 1), 72) AS tenure_months,
       least(greatest(support_tickets, 0), 10) AS support_tickets FROM customers""",
        "not_null_orders": f"WITH {GAPS} " + " UNION ALL ".join(
            f"SELECT 'orders' AS table_name, '{c}' AS column_name, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM orders_with_gaps"
            for c in ("o_custkey", "o_totalprice", "pr")),
        "order_key_duplicates": f"""WITH {GAPS}
SELECT o_custkey, pr, count(*) AS rows FROM orders_with_gaps WHERE pr IS NOT NULL
GROUP BY 1, 2 HAVING count(*) > 1""",
        **_fitted(),
    }
