"""Report pipeline on the sample tables, shared by several registered queries."""

from functools import reduce

from pyspark.sql import functions as F

from spendframe.functions.money import currency_columns
from spendframe.operators import fx, reports
from spendframe.plans.views import exact_product
from spendframe.sources import sample

# Sample policies: later ones build on earlier ones, one is for two workspaces only, one for projects, one for all configs.
POLICIES = [
    {
        "report_adjustment_policy_id": "rap-project",
        "cost_report_config_id": "crc-project",
        "scope": "PROJECT",
        "order": 1,
        "policy_filter": {"project_ids": ["project-building-1", "project-household-2"]},
        "adjustments": [
            {"name": "Overhead", "unit": "PERCENT", "value": 7.12345, "provider": "asia", "order": 1},
            {"name": "Seat", "unit": "FIXED", "value": 1000, "currency": "JPY", "order": 2},
        ],
    },
    {
        "report_adjustment_policy_id": "rap-all",
        "scope": "WORKSPACE",
        "order": 9,
        "adjustments": [{"name": "Levy", "unit": "PERCENT", "value": 0.5}],
    },
    {
        "report_adjustment_policy_id": "rap-late",
        "cost_report_config_id": "crc-workspace",
        "scope": "WORKSPACE",
        "order": None,
        "policy_filter": {"workspace_ids": ["building", "household"]},
        "adjustments": [{"name": "Late fee", "unit": "PERCENT", "value": 2.5, "order": 1}],
    },
    {
        "report_adjustment_policy_id": "rap-base",
        "cost_report_config_id": "crc-workspace",
        "scope": "WORKSPACE",
        "order": 1,
        "policy_filter": {"workspace_ids": []},
        "adjustments": [
            {"name": "Support", "unit": "FIXED", "value": 150.25, "currency": "USD", "provider": "asia", "order": 2},
            {"name": "Discount", "unit": "PERCENT", "value": -10, "provider": "asia", "order": 1},
        ],
    },
    {
        "report_adjustment_policy_id": "rap-tax",
        "cost_report_config_id": "crc-workspace",
        "scope": "WORKSPACE",
        "order": 2,
        "policy_filter": {"workspace_ids": []},
        "adjustments": [
            {
                "name": "Tax",
                "unit": "PERCENT",
                "value": 7,
                "order": 1,
                "adjustment_filter": [{"k": "provider", "v": ["asia", "europe"], "o": "in"}],
            }
        ],
    },
]


def planned_reports(unified):
    months = unified.select(F.col("billed_month").alias("report_month")).distinct()
    return reports.calendar_regenerate(sample.report_configs_for(months), F.col("report_month"))


def _heads(unified, planned, scope):
    collapsed = reports.collapse(reports.report_base(unified, scope), scope)
    return reports.build_reports(collapsed, planned, scope)


HEAD_COLUMNS = [
    "cost_report_id", "cost_report_config_id", "scope", "name", "currency", "status", "is_done", "applies_adjustments", "issue_date",
    "report_year", "currency_date", "bank_name", "workspace_id", "project_id", "service_account_id", "usage_type", "usage_unit",
    "region_key", "region_code", *currency_columns(), "report_month",
]


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def filled(df, *names):
    """The named columns, null where the scope has none."""
    return df.select(*[F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name) for name in names])


def report_heads(spark, sf_dir):
    """The stored reports of every month and scope."""

    def build():
        unified = sample.unified(spark, sf_dir)
        planned = planned_reports(unified)
        return union([filled(_heads(unified, planned, scope), *HEAD_COLUMNS) for scope in reports.SCOPE_IDS])

    return sample.stored(spark, sf_dir, "report-heads", build, "report_month")


def reports_and_lines(spark, sf_dir):
    """The stored reports and detail lines of every month and scope."""
    heads = report_heads(spark, sf_dir)

    def build():
        unified = sample.unified(spark, sf_dir)
        return union([reports.report_lines(unified, heads.where(F.col("scope") == scope), scope) for scope in reports.SCOPE_IDS])

    return heads, sample.stored(spark, sf_dir, "report-lines", build, "report_month")


def report_rates(spark, sf_dir, heads):
    dates = heads.select(F.to_date("currency_date").alias("as_of")).distinct()
    return fx.with_defaults(fx.asof_rates_for(dates, sample.fx_quotes(spark, sf_dir)), dates)


# Configs of the sample: id, and the columns that name a report besides its month.
CONFIG_IDS = {"crc-workspace": ["workspace_id"], "crc-project": ["workspace_id", "project_id"], "crc-account": ["workspace_id", "service_account_id"]}


def report_id(config: str) -> str:
    return f"'{config}:' || billed_month || ':' || " + " || ':' || ".join(f"coalesce({name}, '-')" for name in CONFIG_IDS[config])


# Every line of unified cost with the reports it belongs to, one of each config.
REPORT_LINES_SQL = " UNION ALL ".join(
    f"""SELECT {report_id(config)} AS cost_report_id, '{config}' AS config, unified.* EXCLUDE (currency),
  {"project_id" if "project_id" in ids else "CAST(NULL AS varchar)"} AS head_project,
  {"service_account_id" if "service_account_id" in ids else "CAST(NULL AS varchar)"} AS head_account
FROM unified WHERE workspace_id IS NOT NULL"""
    for config, ids in CONFIG_IDS.items()
)
_EXACT = "decimal(28,12)"


def share(amount: str, percent: str) -> str:
    return f"CAST({exact_product(f'CAST({amount} AS {_EXACT})', f'CAST({percent} AS decimal(24,18))')} AS {_EXACT})"


def converted(amount: str) -> str:
    return f"CAST({exact_product(f'CAST({amount} AS {_EXACT})', 'r.rate')} AS {_EXACT})"


# Sums per report and currency for the provider sets that the percentages look at, then the steps in order. Reports of
# accounts are not adjusted.
ADJUSTMENT_STEPS_SQL = f"""
WITH report_line AS ({REPORT_LINES_SQL}),
line AS (
  SELECT *, 'KRW' AS currency, "cost_KRW" AS cost FROM report_line
  UNION ALL SELECT *, 'USD', "cost_USD" FROM report_line
  UNION ALL SELECT *, 'JPY', "cost_JPY" FROM report_line),
summed AS (
  SELECT cost_report_id, config, workspace_id, head_project, billed_month, l.currency, max(exchange_date) AS exchange_date,
         CAST(coalesce(sum(CASE WHEN provider = 'asia' THEN cost END), 0) AS {_EXACT}) AS asia,
         CAST(coalesce(sum(CASE WHEN provider IN ('asia', 'europe') THEN cost END), 0) AS {_EXACT}) AS both_,
         CAST(coalesce(sum(cost), 0) AS {_EXACT}) AS everything,
         count(*) FILTER (WHERE provider = 'asia') AS n_asia
  FROM line l WHERE config <> 'crc-account' GROUP BY ALL),
base AS (
  SELECT s.*, {converted("150.25")} AS support
  FROM summed s JOIN rate r ON r.exchange_date = CAST(s.exchange_date AS date) AND r.from_currency = 'USD' AND r.to_currency = s.currency),
seated AS (
  SELECT b.*, {converted("1000")} AS seat,
         config = 'crc-project' AND coalesce(head_project IN ('project-building-1', 'project-household-2'), false) AS listed
  FROM base b JOIN rate r ON r.exchange_date = CAST(b.exchange_date AS date) AND r.from_currency = 'JPY' AND r.to_currency = b.currency),
one AS (
  SELECT *, CASE WHEN config = 'crc-workspace' AND n_asia > 0 THEN {share("asia", "-0.1")} END AS discount,
         CASE WHEN listed AND n_asia > 0 THEN {share("asia", "0.0712345")} END AS overhead FROM seated),
two AS (
  SELECT *, CASE WHEN config = 'crc-workspace' THEN {share("both_ + coalesce(discount, 0) + support", "0.07")} END AS tax FROM one),
three AS (
  SELECT *, {share("everything + coalesce(discount, 0) + CASE WHEN config = 'crc-workspace' THEN support ELSE 0 END + coalesce(tax, 0) + coalesce(overhead, 0) + CASE WHEN listed THEN seat ELSE 0 END", "0.005")} AS levy
  FROM two),
four AS (
  SELECT *, CASE WHEN config = 'crc-workspace' AND workspace_id IN ('building', 'household')
    THEN {share("everything + coalesce(discount, 0) + support + tax + levy", "0.025")} END AS late FROM three),
added AS (
  SELECT *, 'rap-base' AS policy, 'Discount' AS product, 'asia' AS provider, discount AS amount FROM four WHERE discount IS NOT NULL
  UNION ALL SELECT *, 'rap-base', 'Support', 'asia', support FROM four WHERE config = 'crc-workspace'
  UNION ALL SELECT *, 'rap-tax', 'Tax', NULL, tax FROM four WHERE tax IS NOT NULL
  UNION ALL SELECT *, 'rap-project', 'Overhead', 'asia', overhead FROM four WHERE overhead IS NOT NULL
  UNION ALL SELECT *, 'rap-project', 'Seat', NULL, seat FROM four WHERE listed
  UNION ALL SELECT *, 'rap-all', 'Levy', NULL, levy FROM four
  UNION ALL SELECT *, 'rap-late', 'Late fee', NULL, late FROM four WHERE late IS NOT NULL)
"""


def wide_amounts(value: str) -> str:
    """Pivot of per-currency rows into the three output columns."""
    return ",\n".join(
        f"""CAST(CAST(sum(CASE WHEN currency = '{c}' THEN {value} END) AS decimal(38,2)) AS double) AS "cost_{c}\""""
        for c in ("KRW", "USD", "JPY")
    )


ADJUSTED_TOTAL_SQL = (
    ADJUSTMENT_STEPS_SQL
    + f"""
SELECT cost_report_id, {wide_amounts("amount")}
FROM (SELECT cost_report_id, currency, cost AS amount FROM line UNION ALL SELECT cost_report_id, currency, amount FROM added)
GROUP BY cost_report_id
"""
)
