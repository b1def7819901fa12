"""Aggregations. Daily questions read the daily lines, all others the stored monthly table."""

from pyspark.sql import functions as F

from spendframe.functions.money import as_double, currency_columns
from spendframe.functions.predicates import where
from spendframe.operators import accounts, adjustments, analyze, budgets, reports
from spendframe.operators.projection import bag_to_columns
from spendframe.operators.rollup import monthly_rollup
from spendframe.operators.unified import unify
from spendframe.plans import pipeline
from spendframe.plans.registry import query
from spendframe.session import durable
from spendframe.sources import sample

_SUMS = {"cost": {"key": "cost", "operator": "sum"}, "usage_quantity": {"key": "usage_quantity", "operator": "sum"}}
_TWO = "CAST(CAST({0} AS decimal(38,2)) AS double)"


def _analyze(spark, sf_dir, granularity, fields=None, **question):
    names = ["product", "provider", "tags", "data", "data_source_id", "billed_date", "cost", "usage_quantity"]
    daily = sample.cost(spark, sf_dir, *names) if granularity == "DAILY" else None
    monthly = None if granularity == "DAILY" else sample.monthly(spark, sf_dir)
    return analyze.analyze_by_granularity(daily, monthly, granularity, fields=fields or _SUMS, **question)


@query(
    "agg_analyze_daily",
    """
SELECT product, provider, tag_status AS status, billed_date AS date, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost,
       sum(usage_quantity) AS usage_quantity, CAST(sum(data_discount) AS double) AS discount
FROM cost WHERE billed_date >= '1998-01-01' AND billed_date < '1998-02-01' AND data_source_id <> 'ds-1'
GROUP BY ALL
""",
    ("cost",),
)
def agg_analyze_daily(spark, sf_dir):
    grouped = _analyze(
        spark,
        sf_dir,
        "DAILY",
        fields={**_SUMS, "discount": {"key": "data.discount", "operator": "sum"}},
        group_by=["product", "provider", {"key": "tags.status", "name": "status"}],
        start="1998-01-01",
        end="1998-01-31",
        conditions=[{"k": "data_source_id", "v": "ds-1", "o": "not"}],
    )
    return as_double(grouped, "cost", "discount", "usage_quantity")


@query(
    "agg_analyze_monthly",
    """
SELECT workspace_id, product, billed_month AS date, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost, sum(usage_quantity) AS usage_quantity
FROM monthly GROUP BY ALL
""",
    ("monthly",),
)
def agg_analyze_monthly(spark, sf_dir):
    grouped = _analyze(spark, sf_dir, "MONTHLY", group_by=["workspace_id", "product"])
    return as_double(grouped, "cost", "usage_quantity")


@query(
    "agg_analyze_yearly",
    """
SELECT provider, region_code, billed_year AS date, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost, sum(usage_quantity) AS usage_quantity
FROM monthly WHERE billed_year >= '1997' AND billed_year < '2000' GROUP BY ALL
""",
    ("monthly",),
)
def agg_analyze_yearly(spark, sf_dir):
    grouped = _analyze(spark, sf_dir, "YEARLY", group_by=["provider", "region_code"], start="1997", end="1999")
    return as_double(grouped, "cost", "usage_quantity")


@query(
    "agg_analyze_bags",
    """
SELECT tag_priority AS priority, info_size AS size, billed_month AS date, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost,
       CAST(sum(data_discount) AS double) AS discount
FROM monthly WHERE tag_status = 'F' OR tag_priority = '1-URGENT' GROUP BY ALL
""",
    ("monthly",),
)
def agg_analyze_bags(spark, sf_dir):
    """A monthly question by a tag and an info key, with a data key summed and a tag in the filter."""
    grouped = _analyze(
        spark,
        sf_dir,
        "MONTHLY",
        fields={"cost": {"key": "cost", "operator": "sum"}, "discount": {"key": "data.discount", "operator": "sum"}},
        group_by=[{"key": "tags.priority", "name": "priority"}, {"key": "additional_info.size", "name": "size"}],
        either=[{"k": "tags.status", "v": "F", "o": "eq"}, {"k": "tags.priority", "v": "1-URGENT", "o": "eq"}],
    )
    return as_double(grouped, "cost", "discount")


@query(
    "agg_analyze_nogran",
    """
SELECT data_source_id, usage_type, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost, sum(usage_quantity) AS usage_quantity
FROM monthly GROUP BY ALL
""",
    ("monthly",),
)
def agg_analyze_nogran(spark, sf_dir):
    grouped = _analyze(spark, sf_dir, None, group_by=["data_source_id", "usage_type"])
    return as_double(grouped, "cost", "usage_quantity")


def _unified_fields():
    return {name: {"key": name, "operator": "sum"} for name in currency_columns()}


_UNIFIED_SUMS = ",\n".join(
    _TWO.format(f'sum("cost_{currency}")') + f' AS "cost_{currency}"' for currency in ("KRW", "USD", "JPY")
)


@query(
    "agg_unified_monthly",
    f"SELECT workspace_name, product, billed_month AS date, {_UNIFIED_SUMS} FROM unified GROUP BY ALL",
    ("unified",),
)
def agg_unified_monthly(spark, sf_dir):
    grouped = analyze.analyze(
        sample.unified(spark, sf_dir), fields=_unified_fields(), group_by=["workspace_name", "product"], granularity="MONTHLY"
    )
    return as_double(grouped, *currency_columns(), scale=2)


@query(
    "agg_unified_yearly",
    f"SELECT project_id, billed_year AS date, {_UNIFIED_SUMS} FROM unified GROUP BY ALL",
    ("unified",),
)
def agg_unified_yearly(spark, sf_dir):
    grouped = analyze.analyze(
        sample.unified(spark, sf_dir), fields=_unified_fields(), group_by=["project_id"], granularity="YEARLY"
    )
    return as_double(grouped, *currency_columns(), scale=2)


@query(
    "agg_monthly_rollup",
    """
SELECT data_source_id, job_id, job_task_id, billed_month, usage_unit, provider, region_code, region_key, product,
       usage_type, resource, service_account_id, project_id, workspace_id, billed_year,
       tag_priority AS tags_priority, tag_status AS tags_status, info_size AS additional_info_size,
       CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost, sum(usage_quantity) AS usage_quantity, CAST(sum(data_discount) AS double) AS data_discount
FROM cost GROUP BY ALL
""",
    ("cost",),
)
def agg_monthly_rollup(spark, sf_dir):
    rolled = monthly_rollup(sample.cost(spark, sf_dir), sample.DATA_KEYS)
    bags = {"tags": sample.TAG_KEYS, "additional_info": sample.INFO_KEYS, "data": sample.DATA_KEYS}
    for bag, keys in bags.items():
        rolled = bag_to_columns(rolled, bag, keys)
    return as_double(rolled, "cost", "usage_quantity", "data_discount")


@query(
    "agg_unified_rollup",
    """
SELECT workspace_id, project_id, service_account_id, data_source_id, product, provider, region_code, region_key,
       usage_type, usage_unit, billed_year, billed_month, CAST(CAST(amount AS decimal(38,6)) AS double) AS cost, usage_quantity
FROM unified
""",
    ("unified",),
)
def agg_unified_rollup(spark, sf_dir):
    grouped = unify(
        sample.routed_monthly(spark, sf_dir),
        # As stored rows they have a size, so lookups move no rows before they are grouped.
        durable(sample.accounts(spark, sf_dir), "accounts"),
        durable(sample.workspaces(spark, sf_dir), "workspaces"),
        sample.sources(spark),
    )
    return as_double(grouped, "cost", "usage_quantity")


_SCOPES = {
    "WORKSPACE": ("workspace_name", []),
    "PROJECT": ("project_name", ["project_id"]),
    "SERVICE_ACCOUNT": ("service_account_name", ["service_account_id"]),
}


def _each_scope(template):
    """The SQL for each scope; `{name}` is its name column, `{ids}` its id columns, `{others}` those of other scopes as nulls."""
    every = ["project_id", "service_account_id"]
    return " UNION ALL BY NAME ".join(
        template.format(
            scope=scope,
            name=name,
            ids="".join(f", {column}" for column in ids),
            others="".join(f", CAST(NULL AS varchar) AS {column}" for column in every if column not in ids),
        )
        for scope, (name, ids) in _SCOPES.items()
    )


@query(
    "agg_report_cost",
    _each_scope(
        f"""
SELECT '{{scope}}' AS scope, workspace_id, {{name}} AS name{{ids}}{{others}}, billed_year, billed_month, exchange_date, usage_type, usage_unit,
       region_key, region_code, {_UNIFIED_SUMS}
FROM unified WHERE workspace_id IS NOT NULL AND data_source_id IN ('ds-0', 'ds-1', 'ds-2') GROUP BY ALL
"""
    ),
    ("unified",),
)
def agg_report_cost(spark, sf_dir):
    kept = accounts.report_sources(sample.sources(spark), sample.WORKSPACES)
    workspaces, unified = sample.workspaces(spark, sf_dir), sample.unified(spark, sf_dir)
    keys = ["billed_year", "billed_month", "exchange_date", "usage_type", "usage_unit", "region_key", "region_code"]

    def base(scope, name):
        found = reports.report_base(unified, scope, workspaces, kept)
        found = found.withColumns({"scope": F.lit(scope), "name": F.col(name)})
        return pipeline.filled(found, "scope", "name", "workspace_id", "project_id", "service_account_id", *keys, *currency_columns())

    return as_double(pipeline.union([base(scope, name) for scope, (name, _) in _SCOPES.items()]), *currency_columns(), scale=2)


@query(
    "agg_report_collapse",
    _each_scope(
        f"""
SELECT '{{scope}}' AS scope, workspace_id, {{name}} AS name{{ids}}{{others}}, billed_year, billed_month, exchange_date,
       min_by(region_key, (coalesce(region_key, ''), coalesce(usage_type, ''), coalesce(usage_unit, ''))) AS region_key,
       {_UNIFIED_SUMS}
FROM unified WHERE workspace_id IS NOT NULL GROUP BY ALL
"""
    ),
    ("unified",),
)
def agg_report_collapse(spark, sf_dir):
    unified = sample.unified(spark, sf_dir)

    def collapsed(scope, name):
        found = reports.collapse(reports.report_base(unified, scope), scope).withColumns({"scope": F.lit(scope), "name": F.col(name)})
        keys = ["workspace_id", "project_id", "service_account_id", "billed_year", "billed_month", "exchange_date", "region_key"]
        return pipeline.filled(found, "scope", "name", *keys, *currency_columns())

    return as_double(pipeline.union([collapsed(scope, name) for scope, (name, _) in _SCOPES.items()]), *currency_columns(), scale=2)


@query(
    "agg_report_collapse_workspace",
    f"""
SELECT workspace_id, billed_year, billed_month, exchange_date,
       min_by(region_key, (coalesce(region_key, ''), coalesce(usage_type, ''), coalesce(usage_unit, ''))) AS region_key, {_UNIFIED_SUMS}
FROM unified WHERE workspace_id IS NOT NULL GROUP BY ALL
""",
    ("unified",),
)
def agg_report_collapse_workspace(spark, sf_dir):
    """The variant that collapses the rows of project reports to one for each workspace."""
    found = reports.collapse(reports.report_base(sample.unified(spark, sf_dir), "PROJECT"), "PROJECT", by_workspace=True)
    keys = ["workspace_id", "billed_year", "billed_month", "exchange_date", "region_key"]
    return as_double(found.select(*keys, *currency_columns()), *currency_columns(), scale=2)


@query(
    "agg_report_data",
    f"""
WITH report_line AS ({pipeline.REPORT_LINES_SQL})
SELECT cost_report_id, billed_month AS report_month, workspace_id, project_id, service_account_id, data_source_id, product, provider, {_UNIFIED_SUMS}
FROM report_line GROUP BY ALL
""",
    ("unified",),
)
def agg_report_data(spark, sf_dir):
    _, lines = pipeline.reports_and_lines(spark, sf_dir)
    keys = ["workspace_id", "project_id", "service_account_id", "data_source_id", "product", "provider"]
    return as_double(
        lines.select("cost_report_id", "report_month", *keys, *currency_columns()), *currency_columns(), scale=2
    )


@query(
    "agg_report_data_analyze",
    f"""
WITH report_line AS ({pipeline.REPORT_LINES_SQL})
SELECT config AS cost_report_config_id, provider, billed_month AS date, {_UNIFIED_SUMS} FROM report_line GROUP BY ALL
""",
    ("unified",),
)
def agg_report_data_analyze(spark, sf_dir):
    _, lines = pipeline.reports_and_lines(spark, sf_dir)
    grouped = analyze.analyze(
        lines, fields=_unified_fields(), group_by=["cost_report_config_id", "provider"], granularity="MONTHLY", date_column="report_month"
    )
    return as_double(grouped, *currency_columns(), scale=2)


@query("agg_report_total", pipeline.ADJUSTED_TOTAL_SQL, ("unified", "rate"))
def agg_report_total(spark, sf_dir):
    heads, lines = pipeline.reports_and_lines(spark, sf_dir)
    adjusted = adjustments.apply_policies(heads, lines, pipeline.POLICIES, pipeline.report_rates(spark, sf_dir, heads))
    totals = reports.adjusted_totals(heads, adjusted)
    return as_double(
        totals.select("cost_report_id", *currency_columns()), *currency_columns(), scale=2
    )


@query(
    "agg_distinct",
    "SELECT DISTINCT product AS value FROM monthly WHERE provider = 'asia'",
    ("monthly",),
)
def agg_distinct(spark, sf_dir):
    return analyze.distinct_values(sample.monthly(spark, sf_dir), "product", [{"k": "provider", "v": "asia", "o": "eq"}])


@query(
    "agg_distinct_batches",
    """
SELECT DISTINCT job_id, job_task_id, billed_month FROM cost
WHERE data_source_id = 'ds-1' AND job_id <> 'job-1999' AND billed_month BETWEEN '1997-03' AND '2000-06'
""",
    ("cost",),
)
def agg_distinct_batches(spark, sf_dir):
    conditions = [
        {"k": "data_source_id", "v": "ds-1", "o": "eq"},
        {"k": "job_id", "v": "job-1999", "o": "not"},
        {"k": "billed_month", "v": "1997-03", "o": "gte"},
        {"k": "billed_month", "v": "2000-06", "o": "lte"},
    ]
    keys = ["job_id", "job_task_id", "billed_month"]
    rows = sample.cost(spark, sf_dir, "data_source_id", *keys)
    return rows.where(where(conditions)).select(*keys).distinct()


@query(
    "agg_count",
    "SELECT data_source_id, billed_year, count(*) AS total_count FROM cost GROUP BY ALL",
    ("cost",),
)
def agg_count(spark, sf_dir):
    return analyze.count_rows(sample.cost(spark, sf_dir, "data_source_id", "billed_year"), "data_source_id", "billed_year")


@query(
    "agg_account_counts",
    """
SELECT s.data_source_id, count(a.account_id) AS data_source_account_count,
       count(DISTINCT a.workspace_id) AS connected_workspace_count
FROM source s LEFT JOIN account a ON a.data_source_id = s.data_source_id
 AND (s.resource_group <> 'WORKSPACE' OR a.workspace_id = s.workspace_id)
GROUP BY ALL
""",
    ("source", "account"),
)
def agg_account_counts(spark, sf_dir):
    return accounts.account_counts(sample.sources(spark), sample.accounts(spark, sf_dir))


@query(
    "agg_budget_usage_analyze",
    f"""
SELECT m.date, m.workspace_id, sum(CASE WHEN m.time_unit = 'TOTAL' THEN 0 ELSE m.planned_limit END) AS "limit",
       {_TWO.format("sum(coalesce(c.cost, 0))")} AS cost
FROM budget_month m
LEFT JOIN budget_cost c ON c.budget_id = m.budget_id AND c.billed_month = m.date
GROUP BY ALL
""",
    ("budget_month", "budget_cost"),
)
def agg_budget_usage_analyze(spark, sf_dir):
    usage = budgets.budget_usage(sample.stored_budgets(spark, sf_dir), sample.unified(spark, sf_dir))
    fields = {"cost": {"key": "cost", "operator": "sum"}, "limit": {"key": "limit", "operator": "sum"}}
    grouped = analyze.analyze(usage, fields=fields, group_by=["workspace_id"], granularity="MONTHLY", date_column="date")
    return as_double(grouped, "cost", scale=2)


@query(
    "agg_account_analyze",
    """
SELECT workspace_id, is_linked, count(*) AS account_count FROM account GROUP BY ALL
""",
    ("account",),
)
def agg_account_analyze(spark, sf_dir):
    return sample.accounts(spark, sf_dir).groupBy("workspace_id", "is_linked").agg(F.count("*").alias("account_count"))


@query(
    "agg_entity_stat",
    """
SELECT 'budget' AS entity, time_unit AS kind, count(*) AS total_count FROM budget GROUP BY ALL
UNION ALL SELECT 'job', job_id, count(DISTINCT job_task_id) FROM cost GROUP BY ALL
UNION ALL SELECT 'role_binding', role_type, count(*) FROM role_binding GROUP BY ALL
""",
    ("budget", "cost", "role_binding"),
)
def agg_entity_stat(spark, sf_dir):
    def stat(entity, kind, df):
        counted = analyze.count_rows(df.select(F.col(kind).alias("kind")), "kind")
        return counted.select(F.lit(entity).alias("entity"), "kind", "total_count")

    tasks = sample.cost(spark, sf_dir, "job_id", "job_task_id").distinct()
    return (
        stat("budget", "time_unit", sample.budgets(spark, sf_dir))
        .union(stat("job", "job_id", tasks))
        .union(stat("role_binding", "role_type", sample.role_bindings(spark, sf_dir)))
    )
