"""Order, pages and id sets."""

from pyspark.sql import functions as F

from spendframe.functions.money import as_double, total
from spendframe.operators import analyze, lookups, paging
from spendframe.plans.registry import query
from spendframe.schema import COST_LIST_LIMIT, REPORT_LIST_LIMIT
from spendframe.sources import sample


@query(
    "srt_order",
    """
SELECT billed_month, workspace_id, cost,
       row_number() OVER (ORDER BY billed_month DESC, workspace_id ASC NULLS FIRST) AS place
FROM (SELECT billed_month, workspace_id, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost FROM cost GROUP BY ALL)
""",
    ("cost",),
)
def srt_order(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "billed_month", "workspace_id", "cost")
    grouped = rows.groupBy("billed_month", "workspace_id").agg(total(F.col("cost")).alias("cost"))
    placed = paging.number_rows(grouped, ["-billed_month", "workspace_id"], "place")
    return as_double(placed.orderBy("place"), "cost")


@query(
    "lim_page",
    """
SELECT product, usage_type, cost, (SELECT count(*) FROM (SELECT DISTINCT product, usage_type FROM cost)) AS total_count
FROM (SELECT product, usage_type, CAST(CAST(sum(cost) AS decimal(38,6)) AS double) AS cost FROM cost GROUP BY ALL)
ORDER BY cost DESC, product, usage_type LIMIT 20 OFFSET 10
""",
    ("cost",),
)
def lim_page(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "product", "usage_type", "cost")
    grouped = rows.groupBy("product", "usage_type").agg(total(F.col("cost")).alias("cost"))
    return as_double(paging.page(grouped, ["-cost", "product", "usage_type"], limit=20, start=11), "cost")


@query(
    "lim_page_cap",
    """
SELECT * FROM (SELECT 'cost' AS entity, cost_id AS id FROM cost ORDER BY cost_id LIMIT 1000)
UNION ALL
SELECT * FROM (SELECT 'report', billed_date || ':' || data_source_id FROM (SELECT DISTINCT billed_date, data_source_id FROM cost)
  ORDER BY billed_date DESC, data_source_id LIMIT 100)
""",
    ("cost",),
)
def lim_page_cap(spark, sf_dir):
    lines = sample.cost(spark, sf_dir, "cost_id")
    days = sample.cost(spark, sf_dir, "billed_date", "data_source_id").distinct()
    costs = paging.page(lines, ["cost_id"], max_limit=COST_LIST_LIMIT)
    heads = paging.page(days, ["-billed_date", "data_source_id"], limit=5000, max_limit=REPORT_LIST_LIMIT)
    return costs.select(F.lit("cost").alias("entity"), F.col("cost_id").alias("id")).union(
        heads.select(F.lit("report"), F.concat_ws(":", "billed_date", "data_source_id"))
    )


@query(
    "lim_first_match",
    """
SELECT service_account_id, min(cost_id) AS cost_id, min_by(resource, cost_id) AS resource FROM cost GROUP BY ALL
""",
    ("cost",),
)
def lim_first_match(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "service_account_id", "cost_id", "resource")
    return lookups.first_by(rows, ["service_account_id"], "cost_id", ["cost_id", "resource"])


@query(
    "set_distinct_search_page",
    """
SELECT value, (SELECT count(DISTINCT region_key) FROM monthly WHERE contains(region_key, 'nation_1')
               OR contains(lower(region_key), 'nation_1')) AS total_count
FROM (SELECT DISTINCT region_key AS value FROM monthly WHERE contains(lower(region_key), 'nation_1'))
ORDER BY value LIMIT 4 OFFSET 2
""",
    ("monthly",),
)
def set_distinct_search_page(spark, sf_dir):
    found = analyze.distinct_values(sample.monthly(spark, sf_dir), "region_key", search="Nation_1")
    return paging.page(found, ["value"], limit=4, start=3)


@query(
    "set_union_ids",
    """
SELECT 'user-' || c_custkey AS id FROM customer WHERE c_custkey % 10 = 0
UNION SELECT service_account_mgr_id FROM service_account WHERE service_account_mgr_id IS NOT NULL
UNION SELECT budget_manager_id FROM budget
""",
    ("service_account", "budget"),
)
def set_union_ids(spark, sf_dir):
    owners = sample.role_bindings(spark, sf_dir).where("role_type = 'WORKSPACE_OWNER'").select("user_id")
    managers = sample.service_accounts(spark, sf_dir).where("service_account_mgr_id is not null")
    budget_managers = sample.budgets(spark, sf_dir).select("budget_manager_id")
    return owners.union(managers.select("service_account_mgr_id")).union(budget_managers).distinct().toDF("id")
