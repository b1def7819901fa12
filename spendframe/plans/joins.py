"""Joins: routing, linking, names, currencies and visibility."""

from pyspark.sql import functions as F

from spendframe.functions.money import as_double, total
from spendframe.operators import accounts, budgets, fx, reports, unified
from spendframe.operators.adjustments import policy_table, with_steps
from spendframe.plans.registry import query
from spendframe.sources import sample


@query(
    "join_account_route",
    "SELECT cost_id, data_source_id, workspace_id, real_workspace_id FROM routed",
    ("routed",),
)
def join_account_route(spark, sf_dir):
    rows = sample.routed(spark, sf_dir, "cost_id", "data_source_id", "account_id", "workspace_id")
    return rows.select("cost_id", "data_source_id", "workspace_id", "real_workspace_id")


@query(
    "join_account_connect",
    """
SELECT a.data_source_id, a.account_id, coalesce(r.workspace_id, a.workspace_id) AS workspace_id,
       r.workspace_id IS NOT NULL AS is_linked
FROM (SELECT data_source_id, account_id, CAST(NULL AS varchar) AS workspace_id FROM account) a
LEFT JOIN (SELECT account_id, min(workspace_id) AS workspace_id FROM workspace_reference GROUP BY ALL) r USING (account_id)
""",
    ("account", "workspace_reference"),
)
def join_account_connect(spark, sf_dir):
    unlinked = sample.accounts(spark, sf_dir).select(
        "data_source_id", "account_id", F.lit(None).cast("string").alias("workspace_id"), F.lit(False).alias("is_linked")
    )
    return accounts.connect_accounts(unlinked, sample.workspaces(spark, sf_dir))


@query(
    "join_account_upsert",
    """
SELECT data_source_id, account_id,
       CASE WHEN k % 6 = 0 THEN 'Renamed ' || k WHEN k % 3 = 0 THEN 'New ' || k ELSE name END AS name,
       CASE WHEN k % 6 = 0 THEN 'renamed' WHEN k % 3 = 0 THEN 'inserted' ELSE 'kept' END AS change
FROM (SELECT *, CAST(substr(account_id, 6) AS integer) AS k FROM account)
""",
    ("account",),
)
def join_account_upsert(spark, sf_dir):
    known = sample.accounts(spark, sf_dir)
    k = F.substring("account_id", 6, 10).cast("int")
    existing = known.where((k % 3 != 0) | (k % 6 == 0)).select("data_source_id", "account_id", "name")
    label = F.when(k % 6 == 0, F.concat(F.lit("Renamed "), k.cast("string"))).when(
        k % 3 == 0, F.concat(F.lit("New "), k.cast("string"))
    )
    incoming = known.where((k % 3 == 0) | (k % 3 == 1)).withColumn("name", F.coalesce(label, F.col("name")))
    return accounts.upsert_accounts(existing, incoming.select("data_source_id", "account_id", "name"))


@query(
    "join_virtual_to_real",
    """
SELECT workspace_id, billed_month, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost, count(*) AS group_count FROM (
  SELECT CASE WHEN a.v_workspace_id IS NOT NULL THEN a.workspace_id ELSE r.workspace_id END AS workspace_id,
         r.billed_month, r.cost
  FROM (SELECT workspace_id, billed_month, sum(cost) AS cost FROM routed GROUP BY ALL) r
  LEFT JOIN account a ON a.v_workspace_id = r.workspace_id)
GROUP BY ALL
""",
    ("routed", "account"),
)
def join_virtual_to_real(spark, sf_dir):
    rows = sample.routed(spark, sf_dir, "data_source_id", "account_id", "workspace_id", "billed_month", "cost")
    grouped = rows.groupBy("workspace_id", "billed_month").agg(total(F.col("cost")).alias("cost"))
    real = accounts.virtual_to_real(grouped, sample.accounts(spark, sf_dir))
    merged = real.groupBy("workspace_id", "billed_month").agg(
        F.sum("cost").alias("cost"), F.count("*").alias("group_count")
    )
    return as_double(merged, "cost")


_NAME_KEYS = ["workspace_id", "project_id", "service_account_id", "data_source_id"]


@query(
    "join_names",
    """
SELECT g.workspace_id, g.project_id, g.service_account_id, g.data_source_id, g.cost,
       w.name AS workspace_name, sa.name AS service_account_name, s.name AS data_source_name, s.currency,
       CASE WHEN g.workspace_id IS NOT NULL THEN coalesce(p.name, g.project_id) END AS project_name
FROM (SELECT workspace_id, project_id, service_account_id, data_source_id, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost FROM cost GROUP BY ALL) g
LEFT JOIN workspace w USING (workspace_id)
LEFT JOIN project p ON p.workspace_id = g.workspace_id AND p.project_id = g.project_id
LEFT JOIN service_account sa ON sa.workspace_id = g.workspace_id AND sa.service_account_id = g.service_account_id
LEFT JOIN source s ON s.data_source_id = g.data_source_id
""",
    ("cost", "workspace", "project", "service_account", "source"),
)
def join_names(spark, sf_dir):
    grouped = sample.cost(spark, sf_dir, *_NAME_KEYS, "cost").groupBy(*_NAME_KEYS).agg(
        total(F.col("cost")).alias("cost")
    )
    named = unified.with_names(
        unified.with_source_currency(grouped, sample.sources(spark)),
        sample.workspaces(spark, sf_dir),
        sample.projects(spark, sf_dir),
        sample.service_accounts(spark, sf_dir),
    )
    return as_double(named, "cost")


@query(
    "join_report_names",
    """
SELECT g.workspace_id, g.project_id, g.service_account_id, g.cost, w.name AS workspace_name,
       coalesce(p.name, '') AS project_name, coalesce(sa.name, '') AS service_account_name
FROM (SELECT workspace_id, project_id, service_account_id, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost FROM cost
      WHERE workspace_id IS NOT NULL GROUP BY ALL) g
LEFT JOIN workspace w USING (workspace_id)
LEFT JOIN project p ON p.workspace_id = g.workspace_id AND p.project_id = g.project_id
LEFT JOIN service_account sa ON sa.workspace_id = g.workspace_id AND sa.service_account_id = g.service_account_id
""",
    ("cost", "workspace", "project", "service_account"),
)
def join_report_names(spark, sf_dir):
    keys = ["workspace_id", "project_id", "service_account_id"]
    rows = sample.cost(spark, sf_dir, *keys, "cost").where(F.col("workspace_id").isNotNull())
    grouped = rows.groupBy(*keys).agg(total(F.col("cost")).alias("cost"))
    named = reports.with_line_names(
        grouped, sample.workspaces(spark, sf_dir), sample.projects(spark, sf_dir), sample.service_accounts(spark, sf_dir)
    )
    return as_double(named, "cost")


@query(
    "join_source_currency",
    """
SELECT c.billed_month, c.data_source_id, coalesce(s.currency, 'USD') AS currency,
       coalesce(s.name, c.data_source_id) AS data_source_name, CAST(CAST(sum(c.cost) AS decimal(38,6)) AS double) AS cost
FROM cost c LEFT JOIN (SELECT * FROM source WHERE data_source_id <> 'ds-2') s USING (data_source_id) GROUP BY ALL
""",
    ("cost", "source"),
)
def join_source_currency(spark, sf_dir):
    grouped = sample.cost(spark, sf_dir, "billed_month", "data_source_id", "cost").groupBy(
        "billed_month", "data_source_id"
    ).agg(total(F.col("cost")).alias("cost"))
    known = sample.sources(spark).where(F.col("data_source_id") != "ds-2")
    return as_double(unified.with_source_currency(grouped, known), "cost")


def _order_days(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return sample.table(spark, sf_dir, "orders").select(day.alias("as_of")).distinct()


@query(
    "join_fx_asof",
    """
SELECT CAST(d.as_of AS varchar) AS as_of, q.from_currency, q.to_currency, CAST(max(q.date) AS varchar) AS rate_date,
       CAST(CAST(CASE WHEN q.from_currency = q.to_currency THEN 1 ELSE max_by(q.close, q.date) END AS decimal(38,10)) AS double) AS rate
FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS as_of FROM orders) d
JOIN fx_quote q ON q.date BETWEEN d.as_of - INTERVAL 15 DAY AND d.as_of
GROUP BY d.as_of, q.from_currency, q.to_currency
""",
    ("fx_quote",),
)
def join_fx_asof(spark, sf_dir):
    rates = fx.asof_rates_for(_order_days(spark, sf_dir), sample.fx_quotes(spark, sf_dir))
    return rates.select(
        F.col("as_of").cast("string").alias("as_of"),
        "from_currency",
        "to_currency",
        F.col("rate_date").cast("string").alias("rate_date"),
        F.round("rate", 10).cast("double").alias("rate"),
    )


@query(
    "join_fx_default",
    """
SELECT CAST(d.as_of AS varchar) AS as_of, p.from_currency, p.to_currency,
       CAST(CAST(CASE WHEN p.from_currency = p.to_currency THEN 1 ELSE coalesce(max_by(q.close, q.date), p.base) END AS decimal(38,10)) AS double) AS rate
FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS as_of FROM orders) d CROSS JOIN pair p
LEFT JOIN fx_quote q ON q.from_currency = p.from_currency AND q.to_currency = p.to_currency
  AND q.date BETWEEN d.as_of - INTERVAL 15 DAY AND d.as_of AND q.date < DATE '1997-01-01'
GROUP BY d.as_of, p.from_currency, p.to_currency, p.base
""",
    ("fx_quote", "pair"),
)
def join_fx_default(spark, sf_dir):
    days = _order_days(spark, sf_dir)
    quotes = sample.fx_quotes(spark, sf_dir).where(F.col("date") < "1997-01-01")
    rates = fx.with_defaults(fx.asof_rates_for(days, quotes), days)
    return rates.select(
        F.col("as_of").cast("string").alias("as_of"),
        "from_currency",
        "to_currency",
        F.round("rate", 10).cast("double").alias("rate"),
    )


@query(
    "join_budget_cost",
    """
SELECT budget_id, billed_month, CAST(CAST(cost AS decimal(38,2)) AS double) AS cost FROM budget_cost
""",
    ("budget_cost",),
)
def join_budget_cost(spark, sf_dir):
    matched = budgets.budget_cost(sample.stored_budgets(spark, sf_dir), sample.unified(spark, sf_dir))
    return as_double(matched, "cost", scale=2)


_POLICIES = [
    ("rap-all", "WORKSPACE", []),
    ("rap-two", "WORKSPACE", ["building", "household"]),
    ("rap-projects", "PROJECT", ["project-building-1", "project-furniture-2"]),
    ("rap-accounts", "SERVICE_ACCOUNT", ["sa-11", "sa-57"]),
]


@query(
    "join_policy_report",
    """
WITH report AS (SELECT DISTINCT workspace_id, project_id, service_account_id, billed_month AS report_month FROM cost)
SELECT 'rap-all' AS report_adjustment_policy_id, * FROM report
UNION ALL SELECT 'rap-two', * FROM report WHERE workspace_id IN ('building', 'household')
UNION ALL SELECT 'rap-projects', * FROM report WHERE project_id IN ('project-building-1', 'project-furniture-2')
UNION ALL SELECT 'rap-accounts', * FROM report WHERE service_account_id IN ('sa-11', 'sa-57')
""",
    ("cost",),
)
def join_policy_report(spark, sf_dir):
    keys = ["workspace_id", "project_id", "service_account_id"]
    heads = sample.cost(spark, sf_dir, *keys, "billed_month").distinct().withColumnRenamed("billed_month", "report_month")
    names = {"WORKSPACE": "workspace_ids", "PROJECT": "project_ids", "SERVICE_ACCOUNT": "service_account_ids"}
    one = {"unit": "PERCENT", "value": 1}
    policies = [
        {"report_adjustment_policy_id": policy_id, "scope": scope, "policy_filter": {names[scope]: ids}, "adjustments": [one]}
        for policy_id, scope, ids in _POLICIES
    ]
    stepped = with_steps(heads.withColumn("cost_report_config_id", F.concat(F.lit("crc-"), F.substring("report_month", 1, 4))), policy_table(spark, policies))
    return stepped.select(*keys, "report_month", F.explode("_steps.report_adjustment_policy_id").alias("report_adjustment_policy_id"))


@query(
    "join_connected_sources",
    """
SELECT CAST(NULL AS varchar) AS workspace_id, data_source_id, name FROM source
WHERE resource_group <> 'DOMAIN' OR NOT use_account_routing
UNION ALL
SELECT DISTINCT a.workspace_id, s.data_source_id, s.name FROM source s JOIN account a USING (data_source_id)
JOIN workspace w ON w.workspace_id = a.workspace_id
WHERE s.resource_group = 'DOMAIN' AND s.use_account_routing
""",
    ("account", "source", "workspace"),
)
def join_connected_sources(spark, sf_dir):
    asking = sample.workspaces(spark, sf_dir).select("workspace_id")
    visible = accounts.connected_sources(sample.sources(spark), sample.accounts(spark, sf_dir), asking)
    return visible.select("workspace_id", "data_source_id", "name")


@query(
    "join_report_sources",
    """
SELECT data_source_id, count(*) AS row_count, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost FROM cost
WHERE data_source_id IN (SELECT data_source_id FROM source WHERE workspace_id IN ('building', '*')
  AND data_source_id IN ('ds-1', 'ds-2', 'ds-3') AND schedule_state = 'ENABLED') GROUP BY ALL
""",
    ("cost", "source"),
)
def join_report_sources(spark, sf_dir):
    kept = accounts.report_sources(sample.sources(spark), ["building"], ["ds-1", "ds-2", "ds-3"])
    rows = sample.cost(spark, sf_dir, "data_source_id", "cost").join(
        kept.select("data_source_id"), "data_source_id", "left_semi"
    )
    grouped = rows.groupBy("data_source_id").agg(F.count("*").alias("row_count"), total(F.col("cost")).alias("cost"))
    return as_double(grouped, "cost")


@query(
    "join_recipients",
    """
WITH candidate AS (
  SELECT budget_id, workspace_id, unnest(['user-' || k, 'user-' || (k + 5)]) AS user_id FROM budget
  UNION SELECT budget_id, workspace_id, budget_manager_id FROM budget WHERE budget_manager_notification = 'ENABLED'
  UNION SELECT b.budget_id, b.workspace_id, s.service_account_mgr_id FROM budget b JOIN service_account s
    ON s.workspace_id = b.workspace_id AND CASE WHEN b.service_account_id IS NOT NULL
       THEN s.service_account_id = b.service_account_id ELSE s.project_id = b.project_id END
    WHERE b.service_account_manager = 'ENABLED' AND s.service_account_mgr_id IS NOT NULL),
chosen AS (
  SELECT c.budget_id, c.user_id FROM candidate c JOIN role_binding r USING (workspace_id, user_id)
  UNION SELECT b.budget_id, r.user_id FROM budget b JOIN role_binding r
    ON r.workspace_id = b.workspace_id AND r.role_type = 'WORKSPACE_OWNER' WHERE b.k = 2)
SELECT c.budget_id, c.user_id, u.email, coalesce(u.language, 'en') AS language
FROM chosen c JOIN app_user u USING (user_id) WHERE u.email_verified
""",
    ("budget", "service_account", "role_binding", "app_user"),
)
def join_recipients(spark, sf_dir):
    return budgets.recipients(
        sample.budgets(spark, sf_dir),
        sample.service_accounts(spark, sf_dir),
        sample.role_bindings(spark, sf_dir),
        sample.users(spark, sf_dir),
    )
