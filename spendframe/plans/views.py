"""SQL definitions of the sample billing tables, used as common table expressions by the oracles."""

_LINES = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(CAST(l_shipdate AS varchar), 1, 10)) AS cost_id,
       CAST(CAST(l_extendedprice AS decimal(12,2)) * (CAST(1 AS decimal(3,2)) - CAST(l_discount AS decimal(3,2)))
         * CASE WHEN l_quantity = 1 THEN CAST('0.00000001' AS decimal(9,8)) ELSE CAST(1 AS decimal(9,8)) END AS decimal(28,12)) AS cost,
       l_quantity AS usage_quantity,
       CASE l_returnflag WHEN 'A' THEN 'Hrs' WHEN 'N' THEN 'GB' END AS usage_unit,
       lower(r_name) AS provider,
       n_name AS region_code,
       lower(r_name) || '.' || n_name AS region_key,
       p_brand AS product,
       p_type AS usage_type,
       CAST(l_partkey AS varchar) AS resource,
       'acct-' || (o_custkey % 40) AS account_id,
       'sa-' || (o_custkey % 200) AS service_account_id,
       CASE WHEN o_custkey % 10 <> 0 THEN 'project-' || lower(c_mktsegment) || '-' || (c_nationkey % 5) END AS project_id,
       CASE WHEN o_custkey % 10 <> 9 THEN lower(c_mktsegment) END AS workspace_id,
       'ds-' || (l_linenumber % 3) AS data_source_id,
       substr(CAST(l_shipdate AS varchar), 1, 4) AS billed_year,
       substr(CAST(l_shipdate AS varchar), 1, 7) AS billed_month,
       substr(CAST(l_shipdate AS varchar), 1, 10) AS billed_date,
       'job-' || substr(CAST(l_shipdate AS varchar), 1, 4) AS job_id,
       'task-' || substr(CAST(l_shipdate AS varchar), 1, 7) AS job_task_id,
       o_orderpriority AS tag_priority,
       CASE WHEN l_linestatus = 'O' THEN o_orderstatus END AS tag_status,
       'size-' || p_size AS info_size,
       CAST(l_extendedprice AS decimal(12,2)) * CAST(l_discount AS decimal(3,2)) AS data_discount
FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
"""



def exact_product(amount: str, rate: str) -> str:
    """Amount (12 decimals) times rate (18 decimals). In one product the digits would not fit, so the rate goes in two parts."""
    high = f"CAST({rate} AS decimal(20,9))"
    return f"(CAST({amount} * {high} AS decimal(38,15)) + CAST({amount} * ({rate} - {high}) AS decimal(38,15)))"


_WORKSPACE_BY = "CASE {0} % 5 WHEN 0 THEN 'automobile' WHEN 1 THEN 'building' WHEN 2 THEN 'furniture' WHEN 3 THEN 'household' ELSE 'machinery' END"

_UNIFIED_KEYS = """workspace_id, project_id, service_account_id, data_source_id, product, provider,
    region_code, region_key, usage_type, usage_unit, billed_year, billed_month"""

# name -> (views it needs, SQL)
VIEWS = {
    "cost": ((), _LINES),
    "billing": (
        ("cost",),
        """
SELECT cost_id, CASE WHEN usage_quantity <> 7 THEN cost END AS cost, usage_quantity, usage_unit, provider,
       CASE WHEN usage_quantity <> 11 THEN region_code END AS region_code, product, usage_type, resource,
       CASE WHEN usage_quantity = 13 THEN NULL WHEN usage_quantity = 17 THEN replace(billed_date, '-', '/')
            ELSE billed_date END AS billed_date
FROM cost
""",
    ),
    "account": (
        (),
        f"""
SELECT 'ds-' || s AS data_source_id, 'acct-' || k AS account_id, 'Account ' || k AS name,
       CASE WHEN k % 8 <> 7 THEN {_WORKSPACE_BY.format("k")} END AS workspace_id,
       'v-workspace-' || s || '-' || k AS v_workspace_id, k % 8 <> 7 AS is_linked
FROM (SELECT DISTINCT c_custkey % 40 AS k FROM customer) CROSS JOIN (VALUES ('0'), ('2'), ('3')) owners(s)
WHERE s = '0' OR (s = '2' AND k % 2 = 0) OR (s = '3' AND k % 5 = 1)
""",
    ),
    "source": (
        (),
        """
SELECT * FROM (VALUES
  ('ds-0', 'Source 0', 'USD', '*', 'DOMAIN', true, 'ENABLED'),
  ('ds-1', 'Source 1', 'KRW', '*', 'DOMAIN', false, 'ENABLED'),
  ('ds-2', 'Source 2', 'JPY', '*', 'DOMAIN', true, 'ENABLED'),
  ('ds-3', 'Source 3', 'USD', 'building', 'WORKSPACE', false, 'DISABLED')
) t(data_source_id, name, currency, workspace_id, resource_group, use_account_routing, schedule_state)
""",
    ),
    "workspace": (
        (),
        f"""
SELECT lower(c_mktsegment) AS workspace_id, 'Workspace ' || c_mktsegment AS name,
       CASE WHEN lower(c_mktsegment) = 'machinery' THEN 'DISABLED' ELSE 'ENABLED' END AS state
FROM (SELECT DISTINCT c_mktsegment FROM customer)
""",
    ),
    "workspace_reference": (
        (),
        f"""
SELECT DISTINCT lower(c_mktsegment) AS workspace_id, 'acct-' || (c_custkey % 40) AS account_id
FROM customer
WHERE c_custkey % 40 % 8 <> 7
  AND {_WORKSPACE_BY.format("(c_custkey % 40)")} = lower(c_mktsegment)
""",
    ),
    "project": (
        (),
        """
SELECT 'project-' || lower(c_mktsegment) || '-' || k AS project_id, lower(c_mktsegment) AS workspace_id,
       'Project ' || c_mktsegment || ' ' || k AS name, 'pg-nation-' || k AS project_group_id, k
FROM (SELECT DISTINCT c_mktsegment, c_nationkey % 5 AS k FROM customer)
""",
    ),
    "project_group": (
        (),
        """
SELECT 'pg-region-' || r_regionkey AS project_group_id, 'pg-root' AS parent_group_id FROM region
UNION ALL
SELECT 'pg-nation-' || n_nationkey, 'pg-region-' || n_regionkey FROM nation
""",
    ),
    "service_account": (
        (),
        f"""
SELECT 'sa-' || n AS service_account_id, 'Service account ' || n AS name, w AS workspace_id,
       CASE WHEN n % 7 <> 0 THEN 'project-' || w || '-' || (n % 3) END AS project_id,
       CASE WHEN n % 4 <> 0 THEN 'user-' || (n % 50) END AS service_account_mgr_id, n
FROM (SELECT n, {_WORKSPACE_BY.format("n")} AS w FROM (SELECT DISTINCT c_custkey % 200 AS n FROM customer))
""",
    ),
    "app_user": (
        (),
        """
SELECT 'user-' || c_custkey AS user_id, 'user-' || c_custkey || '@example.com' AS email,
       c_custkey % 3 <> 0 AS email_verified, CASE WHEN c_custkey % 4 <> 0 THEN 'ko' END AS language
FROM customer
""",
    ),
    "role_binding": (
        (),
        """
SELECT 'user-' || c_custkey AS user_id, lower(c_mktsegment) AS workspace_id,
       CASE WHEN c_custkey % 10 = 0 THEN 'WORKSPACE_OWNER' ELSE 'WORKSPACE_MEMBER' END AS role_type
FROM customer
""",
    ),
    "budget": (
        ("project", "service_account"),
        """
SELECT *, CASE WHEN k % 2 = 0 THEN 'TOTAL' ELSE 'MONTHLY' END AS time_unit,
       CAST(120000 * (k + 1) AS double) AS "limit", CASE WHEN k = 4 THEN 'JPY' ELSE 'USD' END AS currency,
       'ACTIVE' AS state, 'user-' || (k + 10) AS budget_manager_id,
       CASE WHEN k = 3 THEN 'DISABLED' ELSE 'ENABLED' END AS budget_manager_notification,
       CASE WHEN k = 1 THEN 'ENABLED' ELSE 'DISABLED' END AS service_account_manager
FROM (
  SELECT 'budget-' || substr(project_id, 9) AS budget_id, name, workspace_id, project_id,
         CAST(NULL AS varchar) AS service_account_id, k, '1998-01' AS "start", '1998-12' AS "end" FROM project
  UNION ALL
  SELECT 'budget-' || substr(project_id, 9) || '-next', name, workspace_id, project_id, NULL, 1, '1998-10', '1999-03'
  FROM project WHERE k = 0
  UNION ALL
  SELECT 'budget-' || service_account_id, name, workspace_id, project_id, service_account_id, n % 5, '1998-01', '1998-12'
  FROM service_account WHERE n % 20 = 1
)
""",
    ),
    "budget_month": (
        ("budget",),
        """
SELECT budget.*, strftime(m, '%Y-%m') AS date, "limit" / 12 AS planned_limit
FROM budget, LATERAL (SELECT unnest(generate_series(CAST("start" || '-01' AS date), CAST("end" || '-01' AS date), INTERVAL 1 MONTH)) AS m)
""",
    ),
    "budget_plan": (
        ("budget",),
        """
SELECT budget_id, threshold, 'PERCENT' AS unit, threshold = 80 AND k % 2 = 0 AS notified
FROM budget CROSS JOIN (VALUES (CAST(80 AS double)), (50), (100)) t(threshold)
""",
    ),
    "pair": (
        (),
        """
SELECT a AS from_currency, b AS to_currency, CAST(rate AS decimal(24,18)) AS base FROM (VALUES
  ('KRW', 'KRW', '1'), ('KRW', 'USD', '0.0007156681922951203'), ('KRW', 'JPY', '0.10699169521856493'),
  ('USD', 'KRW', '1398.6984203441723'), ('USD', 'USD', '1'), ('USD', 'JPY', '149.73205030286636'),
  ('JPY', 'KRW', '9.34880863101326'), ('JPY', 'USD', '0.006686848624246231'), ('JPY', 'JPY', '1')
) t(a, b, rate)
""",
    ),
    "fx_quote": (
        ("pair",),
        """
SELECT date, from_currency, to_currency,
       CAST(base * (CAST(1000 + day(date) % 20 AS decimal(6,0)) * CAST('0.001' AS decimal(4,3))) AS decimal(24,18)) AS close
FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS date FROM orders) CROSS JOIN pair
WHERE day(date) % 7 <> 0
""",
    ),
    "routed": (
        ("cost", "account"),
        """
SELECT c.* EXCLUDE (workspace_id), coalesce(a.v_workspace_id, c.workspace_id) AS workspace_id,
       CASE WHEN c.data_source_id IN ('ds-0', 'ds-2') THEN a.workspace_id ELSE c.workspace_id END AS real_workspace_id
FROM cost c
LEFT JOIN account a ON c.data_source_id IN ('ds-0', 'ds-2') AND a.data_source_id = c.data_source_id AND a.account_id = c.account_id
""",
    ),
    "monthly": (
        ("cost",),
        """
SELECT data_source_id, job_id, job_task_id, billed_month, usage_unit, provider, region_code, region_key, product,
       usage_type, resource, service_account_id, project_id, workspace_id, billed_year, tag_priority, tag_status, info_size,
       sum(cost) AS cost, sum(usage_quantity) AS usage_quantity, sum(data_discount) AS data_discount
FROM cost GROUP BY ALL
""",
    ),
    "calendar": (
        ("cost",),
        """
SELECT billed_month, is_confirmed,
       CASE WHEN is_confirmed THEN fifteenth ELSE DATE '1998-08-20' END AS aggregation_date,
       CASE WHEN is_confirmed THEN fifteenth ELSE DATE '1998-08-20' END AS exchange_date
FROM (
  SELECT billed_month, CAST(billed_month || '-15' AS date) AS fifteenth,
         DATE '1998-08-20' >= CAST(billed_month || '-15' AS date) + INTERVAL 1 MONTH AS is_confirmed
  FROM (SELECT DISTINCT billed_month FROM cost)
)
""",
    ),
    "rate": (
        ("fx_quote", "pair", "calendar"),
        """
SELECT d.exchange_date, p.from_currency, p.to_currency,
       CASE WHEN p.from_currency = p.to_currency THEN p.base
            ELSE coalesce((SELECT q.close FROM fx_quote q
                  WHERE q.from_currency = p.from_currency AND q.to_currency = p.to_currency
                    AND q.date BETWEEN d.exchange_date - INTERVAL 15 DAY AND d.exchange_date
                  ORDER BY q.date DESC LIMIT 1), p.base) END AS rate
FROM (SELECT DISTINCT exchange_date FROM calendar) d CROSS JOIN pair p
""",
    ),
    "folded": (
        ("routed", "account"),
        f"""
SELECT r.* EXCLUDE (workspace_id), coalesce(a.workspace_id, r.workspace_id) AS workspace_id
FROM routed r
LEFT JOIN account a ON a.v_workspace_id = r.workspace_id AND a.workspace_id IS NOT NULL
""",
    ),
    "unified": (
        ("folded", "workspace", "project", "service_account", "source", "calendar", "rate"),
        f"""
SELECT g.*, {exact_product("g.amount", "k.rate")} AS "cost_KRW",
       {exact_product("g.amount", "u.rate")} AS "cost_USD",
       {exact_product("g.amount", "j.rate")} AS "cost_JPY",
       s.currency, s.name AS data_source_name, w.name AS workspace_name,
       CASE WHEN g.workspace_id IS NOT NULL THEN coalesce(p.name, g.project_id) END AS project_name,
       sa.name AS service_account_name, c.is_confirmed,
       CAST(c.exchange_date AS varchar) AS exchange_date, CAST(c.aggregation_date AS varchar) AS aggregation_date
FROM (SELECT {_UNIFIED_KEYS}, sum(cost)::decimal(28,12) AS amount, sum(usage_quantity) AS usage_quantity FROM folded GROUP BY ALL) g
JOIN source s ON s.data_source_id = g.data_source_id AND (s.workspace_id = '*' OR s.workspace_id = g.workspace_id)
JOIN calendar c ON c.billed_month = g.billed_month
JOIN rate k ON k.exchange_date = c.exchange_date AND k.from_currency = s.currency AND k.to_currency = 'KRW'
JOIN rate u ON u.exchange_date = c.exchange_date AND u.from_currency = s.currency AND u.to_currency = 'USD'
JOIN rate j ON j.exchange_date = c.exchange_date AND j.from_currency = s.currency AND j.to_currency = 'JPY'
LEFT JOIN workspace w ON w.workspace_id = g.workspace_id
LEFT JOIN project p ON p.workspace_id = g.workspace_id AND p.project_id = g.project_id
LEFT JOIN service_account sa ON sa.workspace_id = g.workspace_id AND sa.service_account_id = g.service_account_id
WHERE g.workspace_id IS NULL OR w.state = 'ENABLED'
""",
    ),
    "budget_cost": (
        ("budget", "unified"),
        """
SELECT b.budget_id, u.billed_month, sum(CASE WHEN b.currency = 'USD' THEN u."cost_USD" ELSE u."cost_JPY" END) AS cost
FROM budget b JOIN unified u
  ON u.workspace_id = b.workspace_id AND u.billed_month BETWEEN b."start" AND b."end"
 AND CASE WHEN b.service_account_id IS NOT NULL THEN u.service_account_id = b.service_account_id
          ELSE u.project_id = b.project_id END
GROUP BY ALL
""",
    ),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix the SQL with the views it uses, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    if not ordered:
        return sql.strip()
    body = ",\n".join(f"{name} AS ({VIEWS[name][1].strip()})" for name in ordered)
    sql = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(opening):
            return f"{opening}{body},\n{sql[len(opening):]}"
    return f"WITH {body}\n{sql}"
