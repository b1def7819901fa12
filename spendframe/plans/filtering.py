"""Filters and predicates."""

from pyspark.sql import functions as F

from spendframe.functions.periods import in_window
from spendframe.functions.predicates import keyword, where
from spendframe.operators import filters
from spendframe.plans.registry import query
from spendframe.sources import sample


def _kept(spark, sf_dir, *needed):
    names = ["cost_id", *[name for name in needed if name != "cost_id"]]
    return sample.cost(spark, sf_dir, *names)


@query("flt_eq", "SELECT cost_id, provider FROM cost WHERE provider = 'asia'", ("cost",))
def flt_eq(spark, sf_dir):
    return _kept(spark, sf_dir, "provider").where(where([{"k": "provider", "v": "asia", "o": "eq"}]))


@query("flt_not", "SELECT cost_id, project_id FROM cost WHERE project_id IS DISTINCT FROM 'project-building-1'", ("cost",))
def flt_not(spark, sf_dir):
    return _kept(spark, sf_dir, "project_id").where(
        where([{"k": "project_id", "v": "project-building-1", "o": "not"}])
    )


@query(
    "flt_in",
    "SELECT cost_id, workspace_id FROM cost WHERE workspace_id IN ('building', 'machinery') OR workspace_id IS NULL",
    ("cost",),
)
def flt_in(spark, sf_dir):
    return _kept(spark, sf_dir, "workspace_id").where(
        where([{"key": "workspace_id", "value": ["building", "machinery", None], "operator": "in"}])
    )


@query(
    "flt_not_in",
    "SELECT cost_id, workspace_id FROM cost WHERE workspace_id IS NULL OR workspace_id NOT IN ('building', 'machinery')",
    ("cost",),
)
def flt_not_in(spark, sf_dir):
    return _kept(spark, sf_dir, "workspace_id").where(
        where([{"k": "workspace_id", "v": ["building", "machinery"], "o": "not_in"}])
    )


@query(
    "flt_range",
    "SELECT cost_id, billed_month FROM cost WHERE billed_month >= '1997-05' AND billed_month <= '1998-10' AND billed_date < '1998-10-15'",
    ("cost",),
)
def flt_range(spark, sf_dir):
    conditions = [
        {"k": "billed_month", "v": "1997-05", "o": "gte"},
        {"k": "billed_month", "v": "1998-10", "o": "lte"},
        {"k": "billed_date", "v": "1998-10-15", "o": "lt"},
    ]
    rows = sample.cost(spark, sf_dir, "cost_id", "billed_month", "billed_date")
    return rows.where(where(conditions)).drop("billed_date")


@query("flt_contain", "SELECT cost_id, product FROM cost WHERE contains(lower(product), 'brand#1')", ("cost",))
def flt_contain(spark, sf_dir):
    return _kept(spark, sf_dir, "product").where(where([{"k": "product", "v": "BRAND#1", "o": "contain"}]))


@query(
    "flt_or",
    "SELECT cost_id FROM cost WHERE data_source_id = 'ds-1' AND (provider = 'asia' OR contains(lower(usage_type), 'eco'))",
    ("cost",),
)
def flt_or(spark, sf_dir):
    either = [{"k": "provider", "v": "asia", "o": "eq"}, {"k": "usage_type", "v": "eco", "o": "contain"}]
    rows = _kept(spark, sf_dir, "data_source_id", "provider", "usage_type")
    return rows.where(where([{"k": "data_source_id", "v": "ds-1", "o": "eq"}], either)).select("cost_id")


@query(
    "flt_keyword",
    """
SELECT cost_id, product, usage_type, provider FROM cost
WHERE (contains(lower(product), 'brand#2') OR contains(lower(usage_type), 'brand#2') OR contains(lower(provider), 'brand#2'))
  AND (contains(lower(product), 'asia') OR contains(lower(usage_type), 'asia') OR contains(lower(provider), 'asia'))
""",
    ("cost",),
)
def flt_keyword(spark, sf_dir):
    names = ["product", "usage_type", "provider"]
    return _kept(spark, sf_dir, *names).where(keyword("Brand#2 ASIA", names))


@query(
    "flt_tag",
    "SELECT cost_id, tag_status AS status FROM cost WHERE tag_status = 'O' AND tag_priority = '1-URGENT'",
    ("cost",),
)
def flt_tag(spark, sf_dir):
    rows = _kept(spark, sf_dir, "tags").where(
        where([{"k": "tags.status", "v": "O", "o": "eq"}, {"k": "tags.priority", "v": "1-URGENT", "o": "eq"}])
    )
    return rows.select("cost_id", F.col("tags")["status"].alias("status"))


@query(
    "flt_scope",
    "SELECT cost_id, workspace_id, data_source_id FROM cost WHERE workspace_id = 'furniture' AND data_source_id IN ('ds-0', 'ds-2')",
    ("cost",),
)
def flt_scope(spark, sf_dir):
    rows = _kept(spark, sf_dir, "workspace_id", "data_source_id")
    return filters.scoped(rows, workspace_id="furniture", data_source_id=["ds-0", "ds-2"], project_id=None)


@query(
    "flt_user_projects",
    "SELECT cost_id, project_id FROM cost WHERE project_id IS NULL OR project_id IN ('project-building-1', 'project-machinery-3')",
    ("cost",),
)
def flt_user_projects(spark, sf_dir):
    rows = _kept(spark, sf_dir, "project_id")
    return filters.visible_to_projects(rows, ["project-building-1", "project-machinery-3"])


@query(
    "flt_project_group",
    """
WITH RECURSIVE closure(project_group_id) AS (
  SELECT project_group_id FROM project_group WHERE project_group_id IN ('pg-region-0', 'pg-region-1')
  UNION
  SELECT g.project_group_id FROM project_group g JOIN closure c ON g.parent_group_id = c.project_group_id
)
SELECT cost_id, project_id FROM cost
WHERE project_id IN (SELECT project_id FROM project WHERE project_group_id IN (SELECT project_group_id FROM closure))
""",
    ("cost", "project", "project_group"),
)
def flt_project_group(spark, sf_dir):
    spec = {"k": "project_group_id", "v": ["pg-region-0", "pg-region-1"], "o": "in"}
    rows = _kept(spark, sf_dir, "project_id")
    groups = sample.project_groups(spark, sf_dir)
    return filters.in_project_groups(rows, spec, groups, sample.projects(spark, sf_dir)).select("cost_id", "project_id")


@query(
    "flt_virtual_workspace",
    """
SELECT cost_id, workspace_id FROM routed
WHERE workspace_id IN (SELECT v_workspace_id FROM account WHERE workspace_id IN ('building', 'household'))
""",
    ("routed", "account"),
)
def flt_virtual_workspace(spark, sf_dir):
    rows = sample.routed(spark, sf_dir, "cost_id", "workspace_id", "data_source_id", "account_id")
    return filters.in_workspaces(rows, ["building", "household"], sample.accounts(spark, sf_dir)).select("cost_id", "workspace_id")


@query(
    "flt_workspaces_negated",
    """
WITH hit AS (
  SELECT cost_id, coalesce(workspace_id = 'furniture' OR workspace_id IN (SELECT v_workspace_id FROM account WHERE workspace_id = 'building'), false) AS listed
  FROM routed)
SELECT cost_id, CASE WHEN listed THEN 'in' ELSE 'not_in' END AS side FROM hit
""",
    ("routed", "account"),
)
def flt_workspaces_negated(spark, sf_dir):
    """A workspace with accounts and one without, both ways; rows without a workspace are in none."""
    rows = sample.routed(spark, sf_dir, "cost_id", "workspace_id", "data_source_id", "account_id")
    known = sample.accounts(spark, sf_dir).where("workspace_id <> 'furniture'")
    sides = [filters.in_workspaces(rows, ["building", "furniture"], known, negate).select("cost_id", F.lit(name).alias("side")) for name, negate in (("in", False), ("not_in", True))]
    return sides[0].unionByName(sides[1])


@query(
    "flt_date_window",
    """
SELECT 'DAILY' AS granularity, cost_id FROM cost WHERE billed_date >= '1998-01-01' AND billed_date < '1998-01-16'
UNION ALL SELECT 'MONTHLY', cost_id FROM cost WHERE billed_month >= '1997-11' AND billed_month < '1998-02'
UNION ALL SELECT 'YEARLY', cost_id FROM cost WHERE billed_year >= '1999' AND billed_year < '2001'
""",
    ("cost",),
)
def flt_date_window(spark, sf_dir):
    names = ["cost_id", "billed_date", "billed_month", "billed_year"]
    rows = sample.cost(spark, sf_dir, *names)
    windows = {"DAILY": ("1998-01", "1998-01-15"), "MONTHLY": ("1997-11", "1998-01"), "YEARLY": ("1999", "2000")}
    # One scan: each row is listed under the windows that contain it.
    hits = [
        F.when(in_window(start, end, granularity), F.lit(granularity)) for granularity, (start, end) in windows.items()
    ]
    named = F.explode(F.array_compact(F.array(*hits)))
    return rows.select(named.alias("granularity"), "cost_id")


@query(
    "flt_report_status",
    """
SELECT cost_id AS report_id, CASE WHEN usage_unit = 'GB' THEN 'DONE' WHEN usage_unit = 'Hrs' THEN 'ADJUSTING' ELSE 'EXPIRED' END AS status
FROM cost WHERE usage_unit = 'GB' AND data_source_id = 'ds-1'
""",
    ("cost",),
)
def flt_report_status(spark, sf_dir):
    status = F.when(F.col("usage_unit") == "GB", "DONE").when(F.col("usage_unit") == "Hrs", "ADJUSTING")
    reports = _kept(spark, sf_dir, "usage_unit", "data_source_id").select(
        F.col("cost_id").alias("report_id"), status.otherwise("EXPIRED").alias("status"), "data_source_id"
    )
    listed = filters.listed_reports(reports, "any", [{"k": "data_source_id", "v": "ds-1", "o": "eq"}])
    return listed.select("report_id", "status")
