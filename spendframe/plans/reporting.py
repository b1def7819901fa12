"""Unified cost runs and cost reports."""

from pyspark.sql import functions as F

from spendframe.functions.money import as_double, currency_columns
from spendframe.operators import adjustments, reports
from spendframe.operators.unified import month_calendar
from spendframe.plans import pipeline
from spendframe.plans.registry import query
from spendframe.session import literal_rows, new_path
from spendframe.sources import sample
from spendframe.sources.facts import FactTable

_SUMS = ", ".join(
    f'CAST(CAST(sum("cost_{currency}") AS decimal(38,2)) AS double) AS "cost_{currency}"' for currency in ("KRW", "USD", "JPY")
)


def _calendar(spark, sf_dir):
    months = sample.cost(spark, sf_dir, "billed_month").distinct()
    return month_calendar(months, F.lit(sample.AS_OF))


@query("uni_confirmed", "SELECT billed_month, is_confirmed FROM calendar", ("calendar",))
def uni_confirmed(spark, sf_dir):
    return _calendar(spark, sf_dir).select("billed_month", "is_confirmed")


@query(
    "uni_dates",
    """
SELECT billed_month, CASE WHEN confirmed THEN CAST(last_day(m) AS varchar) ELSE '1998-08-20' END AS aggregation_date,
       CASE WHEN confirmed THEN strftime(m, '%Y-%m') || '-20' ELSE '1998-08-20' END AS exchange_date
FROM (SELECT billed_month, m, DATE '1998-08-20' >= last_day(m) + INTERVAL 1 MONTH AS confirmed
      FROM (SELECT DISTINCT billed_month, CAST(billed_month || '-01' AS date) AS m FROM cost))
""",
    ("cost",),
)
def uni_dates(spark, sf_dir):
    months = sample.cost(spark, sf_dir, "billed_month").distinct()
    dated = month_calendar(months, F.lit(sample.AS_OF), {"is_last_day": True, "exchange_day": 20})
    return dated.select("billed_month", *[F.date_format(f"{name}_date", "yyyy-MM-dd").alias(f"{name}_date") for name in ("aggregation", "exchange")])


_UNIFIED_NAMES = [
    "workspace_id",
    "project_id",
    "service_account_id",
    "data_source_id",
    "product",
    "provider",
    "region_key",
    "usage_type",
    "usage_unit",
    "billed_month",
    "usage_quantity",
    "currency",
    "data_source_name",
    "workspace_name",
    "project_name",
    "service_account_name",
    "is_confirmed",
    "exchange_date",
    "aggregation_date",
]


@query(
    "uni_build",
    f"""
SELECT {", ".join(_UNIFIED_NAMES)}, 'Yahoo! Finance' AS exchange_source,
       CAST(CAST("cost_KRW" AS decimal(38,2)) AS double) AS "cost_KRW",
       CAST(CAST("cost_USD" AS decimal(38,2)) AS double) AS "cost_USD",
       CAST(CAST("cost_JPY" AS decimal(38,2)) AS double) AS "cost_JPY"
FROM unified
""",
    ("unified",),
)
def uni_build(spark, sf_dir):
    built = sample.unified(spark, sf_dir).select(*_UNIFIED_NAMES, "exchange_source", *currency_columns())
    return as_double(as_double(built, "usage_quantity"), *currency_columns(), scale=2)


_CONFIG_SQL = """
config(cost_report_config_id, scope, issue_day, is_last_day, period) AS (VALUES
  ('crc-workspace', 'WORKSPACE', 10, false, 3), ('crc-project', 'PROJECT', 31, false, 5), ('crc-account', 'SERVICE_ACCOUNT', 1, true, 0))
"""
_ISSUE_SQL = """CAST(date_trunc('month', {0}) AS date)
  + CAST(CASE WHEN is_last_day THEN day(last_day({0})) ELSE least(issue_day, day(last_day({0}))) END - 1 AS integer)"""


@query(
    "rep_calendar",
    f"""
WITH {_CONFIG_SQL},
day AS (SELECT DISTINCT CAST(o_orderdate AS date) AS t FROM orders),
based AS (
  SELECT *, CAST(CASE WHEN month(t - INTERVAL 7 DAY) <> month(t) THEN t - INTERVAL 1 MONTH ELSE t END AS date) AS b
  FROM day CROSS JOIN config),
issued AS (SELECT *, {_ISSUE_SQL.format("b")} AS issue FROM based)
SELECT CAST(t AS varchar) AS as_of, cost_report_config_id, strftime(b - INTERVAL 1 MONTH, '%Y-%m') AS report_month,
       CAST(issue AS varchar) AS issue_date, CASE WHEN t < issue THEN 'IN_PROGRESS' ELSE 'ADJUSTING' END AS status,
       t >= issue AND t >= issue + period AS is_done, t >= issue AND period > 0 AS applies_adjustments
FROM issued
""",
)
def rep_calendar(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").cast("string")
    days = sample.table(spark, sf_dir, "orders").select(day.alias("as_of")).distinct()
    planned = reports.calendar(sample.report_configs_for(days), F.col("as_of"))
    return planned.select(
        "as_of", "cost_report_config_id", "report_month", "issue_date", "status", "is_done", "applies_adjustments"
    )


@query(
    "rep_calendar_regen",
    f"""
WITH {_CONFIG_SQL},
month_ AS (SELECT DISTINCT billed_month, CAST(billed_month || '-01' AS date) + INTERVAL 1 MONTH AS n FROM cost)
SELECT billed_month AS report_month, cost_report_config_id, CAST({_ISSUE_SQL.format("n")} AS varchar) AS issue_date,
       'ADJUSTING' AS status, true AS is_done, period > 0 AS applies_adjustments
FROM month_ CROSS JOIN config
""",
    ("cost",),
)
def rep_calendar_regen(spark, sf_dir):
    months = sample.cost(spark, sf_dir, "billed_month").distinct().withColumnRenamed("billed_month", "report_month")
    planned = reports.calendar_regenerate(sample.report_configs_for(months), F.col("report_month"))
    return planned.select(
        "report_month", "cost_report_config_id", "issue_date", "status", "is_done", "applies_adjustments"
    )


@query(
    "rep_skip_finished",
    f"""
WITH {_CONFIG_SQL},
report_line AS ({pipeline.REPORT_LINES_SQL}),
done AS (SELECT DISTINCT config, billed_month FROM report_line WHERE billed_month < '1998-06' AND config <> 'crc-account')
SELECT c.cost_report_config_id, m.billed_month AS report_month FROM (SELECT DISTINCT billed_month FROM unified) m CROSS JOIN config c
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.config = c.cost_report_config_id AND d.billed_month = m.billed_month)
""",
    ("unified",),
)
def rep_skip_finished(spark, sf_dir):
    """Runs of all configs and months, without those whose report is stored as finished."""
    heads = pipeline.report_heads(spark, sf_dir)
    finished = (F.col("report_month") < "1998-06") & (F.col("cost_report_config_id") != "crc-account")
    stored = heads.withColumn("status", F.when(finished, "DONE").otherwise("ADJUSTING"))
    planned = pipeline.planned_reports(sample.unified(spark, sf_dir))
    return reports.skip_finished(planned, stored).select("cost_report_config_id", "report_month")


def _built_sql(config, currency, ids, name, issue):
    id_text = " || ':' || ".join(f"coalesce({column}, '-')" for column in ids)
    return f"""
SELECT '{config}:' || billed_month || ':' || {id_text} AS cost_report_id, '{config}' AS cost_report_config_id,
       coalesce({name}, 'Unknown') AS name, '{currency}' AS currency, 'ADJUSTING' AS status,
       CAST({issue} AS varchar) AS issue_date, billed_month AS report_month, billed_year AS report_year,
       exchange_date AS currency_date, 'Yahoo! Finance' AS bank_name, {_SUMS}
FROM unified WHERE workspace_id IS NOT NULL
GROUP BY {", ".join(ids)}, {name}, billed_month, billed_year, exchange_date"""


_NEXT_MONTH = "CAST(CAST(billed_month || '-01' AS date) + INTERVAL 1 MONTH AS date)"
_BUILT_SQL = " UNION ALL ".join(
    [
        _built_sql("crc-workspace", "KRW", ["workspace_id"], "workspace_name", f"{_NEXT_MONTH} + 9"),
        _built_sql("crc-project", "USD", ["workspace_id", "project_id"], "project_name", f"last_day({_NEXT_MONTH})"),
        _built_sql(
            "crc-account", "JPY", ["workspace_id", "service_account_id"], "service_account_name", f"last_day({_NEXT_MONTH})"
        ),
    ]
)
_REPORT_NAMES = [
    "cost_report_id",
    "cost_report_config_id",
    "name",
    "currency",
    "status",
    "issue_date",
    "report_month",
    "report_year",
    "currency_date",
    "bank_name",
]


def _all_scopes(spark, sf_dir):
    return pipeline.report_heads(spark, sf_dir).select(*_REPORT_NAMES, *currency_columns())


@query("rep_build", _BUILT_SQL, ("unified",))
def rep_build(spark, sf_dir):
    return as_double(_all_scopes(spark, sf_dir), *currency_columns(), scale=2)


@query(
    "rep_number",
    f"""
WITH built AS ({_BUILT_SQL}),
taken AS (SELECT issue_date, count(*) AS n FROM built WHERE cost_report_config_id = 'crc-project' GROUP BY ALL)
SELECT cost_report_id, issue_date, 'CostReport_' || strftime(CAST(issue_date AS date), '%y%m%d') ||
       CASE WHEN place + coalesce(n, 0) < 1000 THEN lpad(CAST(place + coalesce(n, 0) AS varchar), 4, '0')
            ELSE CAST(place + coalesce(n, 0) AS varchar) END AS report_number
FROM (SELECT cost_report_id, issue_date, row_number() OVER (PARTITION BY issue_date ORDER BY cost_report_id) AS place
      FROM built WHERE cost_report_config_id <> 'crc-project')
LEFT JOIN taken USING (issue_date)
""",
    ("unified",),
)
def rep_number(spark, sf_dir):
    built = _all_scopes(spark, sf_dir).select("cost_report_id", "cost_report_config_id", "issue_date")
    is_old = F.col("cost_report_config_id") == "crc-project"
    numbered = reports.number_reports(built.where(~is_old), built.where(is_old))
    return numbered.select("cost_report_id", "issue_date", "report_number")


def _added(spark, sf_dir, policies):
    heads, lines = pipeline.reports_and_lines(spark, sf_dir)
    return adjustments.adjustment_lines(heads, lines, policies, pipeline.report_rates(spark, sf_dir, heads))


def _policy(name, adjustment, **policy_filter):
    return {
        "report_adjustment_policy_id": name,
        "scope": "WORKSPACE",
        "order": 1,
        "policy_filter": policy_filter,
        "adjustments": [{"order": 1, **adjustment}],
    }


@query(
    "rep_adjust_percent",
    pipeline.ADJUSTMENT_STEPS_SQL
    + f"""
SELECT cost_report_id, billed_month AS report_month, {pipeline.wide_amounts(pipeline.share("asia", "0.1234567"))}
FROM base WHERE n_asia > 0 AND workspace_id IN ('building', 'furniture') GROUP BY ALL
""",
    ("unified", "rate"),
)
def rep_adjust_percent(spark, sf_dir):
    percent = {"name": "Surcharge", "unit": "PERCENT", "value": 12.34567, "provider": "asia"}
    added = _added(spark, sf_dir, [_policy("rap-1", percent, workspace_ids=["building", "furniture"])])
    return as_double(added.select("cost_report_id", "report_month", *currency_columns()), *currency_columns(), scale=2)


@query(
    "rep_adjust_fixed",
    pipeline.ADJUSTMENT_STEPS_SQL
    + f"""
SELECT cost_report_id, billed_month AS report_month, {pipeline.wide_amounts("support")} FROM base GROUP BY ALL
""",
    ("unified", "rate"),
)
def rep_adjust_fixed(spark, sf_dir):
    fixed = {"name": "Support", "unit": "FIXED", "value": 150.25, "currency": "USD"}
    added = _added(spark, sf_dir, [_policy("rap-1", fixed)])
    return as_double(added.select("cost_report_id", "report_month", *currency_columns()), *currency_columns(), scale=2)


@query(
    "rep_adjust_order",
    pipeline.ADJUSTMENT_STEPS_SQL
    + f"""
SELECT cost_report_id, billed_month AS report_month, policy AS report_adjustment_policy_id, product,
       {pipeline.wide_amounts("amount")} FROM added GROUP BY ALL
""",
    ("unified", "rate"),
)
def rep_adjust_order(spark, sf_dir):
    added = _added(spark, sf_dir, pipeline.POLICIES)
    return as_double(
        added.select("cost_report_id", "report_month", "report_adjustment_policy_id", "product", *currency_columns()),
        *currency_columns(),
        scale=2,
    )


@query(
    "rep_adjust_lines",
    pipeline.ADJUSTMENT_STEPS_SQL
    + f"""
SELECT DISTINCT cost_report_id, config AS cost_report_config_id, workspace_id, head_project AS project_id,
       CAST(NULL AS varchar) AS service_account_id, CAST(NULL AS varchar) AS data_source_id,
       billed_month AS report_month, substr(billed_month, 1, 4) AS report_year,
       CAST(CASE config WHEN 'crc-workspace' THEN {_NEXT_MONTH} + 9 ELSE last_day({_NEXT_MONTH}) END AS varchar) AS issue_date,
       policy AS report_adjustment_policy_id, product, provider, true AS is_adjusted, false AS is_confirmed
FROM added
""",
    ("unified", "rate"),
)
def rep_adjust_lines(spark, sf_dir):
    dropped = ["currency_date", "usage_type", "usage_unit", "region_key", "region_code", *currency_columns()]
    return _added(spark, sf_dir, pipeline.POLICIES).drop(*dropped)


@query(
    "rep_finalise",
    f"""
WITH report_line AS ({pipeline.REPORT_LINES_SQL})
SELECT cost_report_id, CASE WHEN billed_month < '1998-06' THEN 'DONE' ELSE 'ADJUSTING' END AS status,
       count(*) AS line_count, CASE WHEN billed_month < '1998-06' THEN count(*) ELSE 0 END AS confirmed_count
FROM (SELECT DISTINCT cost_report_id, billed_month, workspace_id, project_id, service_account_id, data_source_id, product, provider FROM report_line)
GROUP BY cost_report_id, billed_month
""",
    ("unified",),
)
def rep_finalise(spark, sf_dir):
    heads, lines = pipeline.reports_and_lines(spark, sf_dir)
    finished = reports.finish(heads.withColumn("is_done", F.col("report_month") < "1998-06"))
    confirmed = reports.confirm_lines(lines, finished)
    counts = confirmed.groupBy("cost_report_id").agg(
        F.count("*").alias("line_count"), F.count_if("is_confirmed").alias("confirmed_count")
    )
    return finished.select("cost_report_id", "status").join(counts, "cost_report_id")


@query(
    "rep_expire",
    f"""
WITH report_line AS ({pipeline.REPORT_LINES_SQL})
SELECT cost_report_id, version, CASE WHEN is_run AND version = 1 THEN 'EXPIRED' ELSE status END AS status
FROM (
  SELECT cost_report_id, version, status, billed_month LIKE '1998%' AS is_run
  FROM (SELECT DISTINCT cost_report_id, billed_month FROM report_line)
  CROSS JOIN (VALUES (1, 'DONE'), (2, 'IN_PROGRESS'), (3, 'DONE'), (4, 'EXPIRED')) v(version, status))
WHERE NOT (is_run AND version = 2)
""",
    ("unified",),
)
def rep_expire(spark, sf_dir):
    heads = pipeline.report_heads(spark, sf_dir)
    states = [(1, "DONE", "2002-01-01"), (2, "IN_PROGRESS", "2002-02-01"), (3, "DONE", "2002-03-01"), (4, "EXPIRED", "2001-01-01")]
    versions = F.array(
        *[
            F.struct(F.lit(v).alias("version"), F.lit(state).alias("status"), F.lit(day).cast("timestamp").alias("created_at"))
            for v, state, day in states
        ]
    )
    stored = heads.select("cost_report_id", "cost_report_config_id", "report_month", F.inline(versions))
    runs = heads.where(F.col("report_year") == "1998").select("cost_report_config_id", "report_month").distinct()
    runs = runs.withColumn("run_at", F.lit("2002-03-01").cast("timestamp"))
    return reports.expire_reports(stored, runs).select("cost_report_id", "version", "status")


@query(
    "rep_expire_stored",
    f"""
WITH report_line AS ({pipeline.REPORT_LINES_SQL}),
kept AS (
  SELECT cost_report_id || '#' || version AS cost_report_id, CASE WHEN is_run AND version = 1 THEN 'EXPIRED' ELSE status END AS status, n AS line_count
  FROM (
    SELECT cost_report_id, version, status, n, billed_month LIKE '1998%' AS is_run
    FROM (SELECT cost_report_id, billed_month, count(DISTINCT (coalesce(data_source_id, ''), coalesce(product, ''), coalesce(provider, ''),
            coalesce(project_id, ''), coalesce(service_account_id, ''))) AS n FROM report_line GROUP BY ALL)
    CROSS JOIN (VALUES (1, 'DONE'), (2, 'IN_PROGRESS'), (3, 'DONE')) v(version, status))
  WHERE NOT (is_run AND version = 2))
SELECT cost_report_id, status, line_count, true AS second_run_wrote_nothing FROM kept
""",
    ("unified",),
)
def rep_expire_stored(spark, sf_dir):
    """Reports and lines as stored tables: three versions of each report, one run for the months of 1998, made twice."""
    heads, lines = pipeline.reports_and_lines(spark, sf_dir)
    states = [(1, "DONE", "2002-01-01"), (2, "IN_PROGRESS", "2002-02-01"), (3, "DONE", "2002-03-01")]
    versions = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(state).alias("status"), F.lit(day).cast("timestamp").alias("created_at")) for v, state, day in states])
    numbered = F.concat_ws("#", "cost_report_id", F.col("v").cast("string"))
    old = heads.select("cost_report_id", "cost_report_config_id", "report_month", F.inline(versions)).withColumn("cost_report_id", numbered).drop("v")
    details = lines.select("cost_report_id", "report_month", "provider", "product", F.explode(F.array(*[F.lit(v) for v, _, _ in states])).alias("v"))
    details = details.withColumn("cost_report_id", numbered).drop("v")
    stored = FactTable.create(new_path(spark, "reports"), old, ["report_month"])
    held = FactTable.create(new_path(spark, "report-lines"), details, ["report_month"])
    runs = heads.where(F.col("report_year") == "1998").select("cost_report_config_id", "report_month").distinct()
    runs = runs.withColumn("run_at", F.lit("2002-03-01").cast("timestamp"))
    stored, held = reports.expire_stored(stored, held, runs)
    again = reports.expire_stored(stored, held, runs)
    counts = again[1].read().groupBy("cost_report_id").agg(F.count("*").alias("line_count"))
    same = again[0].version == stored.version and again[1].version == held.version
    return again[0].read().select("cost_report_id", "status").join(counts, "cost_report_id", "full").withColumn("second_run_wrote_nothing", F.lit(same))


@query(
    "rep_sync_currency",
    """
SELECT 'ra-' || p_partkey AS report_adjustment_id, 'rap-' || (p_size % 3) AS report_adjustment_policy_id,
       CASE p_size % 3 WHEN 0 THEN 'KRW' WHEN 1 THEN 'JPY' ELSE 'USD' END AS currency
FROM part
""",
)
def rep_sync_currency(spark, sf_dir):
    parts = sample.table(spark, sf_dir, "part").select(
        F.concat(F.lit("ra-"), F.col("p_partkey").cast("string")).alias("report_adjustment_id"),
        F.concat(F.lit("rap-"), (F.col("p_size") % 3).cast("string")).alias("report_adjustment_policy_id"),
        F.lit("USD").alias("currency"),
    )
    owners = [("rap-0", "crc-workspace"), ("rap-1", "crc-account")]
    policies = literal_rows(spark, owners, "report_adjustment_policy_id string, cost_report_config_id string")
    currencies = [("crc-workspace", "KRW"), ("crc-account", "JPY")]
    configs = literal_rows(spark, currencies, "cost_report_config_id string, currency string")
    return adjustments.sync_currency(parts, policies, configs)
