"""Cost reports: calendar, report rows, detail lines, numbering, finishing and expiry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.money import currency_columns, total
from spendframe.functions.periods import day_in_month, first_day, month_of
from spendframe.functions.predicates import all_of
from spendframe.operators.lookups import join_null_safe, keep_matching, lookup, tenant
from spendframe.operators.paging import number_rows
from spendframe.schema import DEFAULT_EXCHANGE_SOURCE, REPORT_RETRY_DAYS, REPORT_RETRY_DAYS_MAX
from spendframe.sources.facts import FactTable, in_partitions

SCOPE_COLUMNS = {
    "WORKSPACE": ["workspace_name"],
    "PROJECT": ["project_id", "project_name"],
    "SERVICE_ACCOUNT": ["service_account_id", "service_account_name"],
}
SCOPE_IDS = {
    "WORKSPACE": ["workspace_id"],
    "PROJECT": ["workspace_id", "project_id"],
    "SERVICE_ACCOUNT": ["workspace_id", "service_account_id"],
}
SCOPE_NAMES = {
    "WORKSPACE": "workspace_name",
    "PROJECT": "project_name",
    "SERVICE_ACCOUNT": "service_account_name",
}


def calendar(configs: DataFrame, as_of: Column, retry_days: int = REPORT_RETRY_DAYS) -> DataFrame:
    """What a scheduled run does on a day: report month, issue date, and the report's status.

    In the first days of a month, as long as the retry window reaches back into the month before,
    the run still belongs to that month. Before the issue date a report is IN_PROGRESS, from then
    on ADJUSTING, and DONE once the adjustment period has passed.
    """
    today = F.to_date(as_of)
    window = min(retry_days, REPORT_RETRY_DAYS_MAX)
    reaches_back = F.month(F.date_sub(today, window)) != F.month(today)
    base = F.when(reaches_back, F.add_months(today, -1)).otherwise(today)
    dated = configs.withColumns({"_today": today, "_base": base}).withColumns(
        {
            "report_month": month_of(F.add_months("_base", -1)),
            "_issue": day_in_month(month_of(F.col("_base")), F.col("issue_day"), F.col("is_last_day")),
        }
    )
    return _flags(dated, F.col("_today") < F.col("_issue"), F.col("_today"))


def calendar_regenerate(configs: DataFrame, report_month: Column) -> DataFrame:
    """Rebuild a given month: always adjusted and finished, issued in the month after it."""
    issue_month = month_of(F.add_months(first_day(F.col("report_month")), 1))
    dated = configs.withColumn("report_month", report_month).withColumn(
        "_issue", day_in_month(issue_month, F.col("issue_day"), F.col("is_last_day"))
    )
    return _flags(dated, F.lit(False), None)


def _flags(dated: DataFrame, too_early: Column, today: Column | None) -> DataFrame:
    period = F.when(F.coalesce("adjustment_enabled", F.lit(False)), F.col("adjustment_period")).otherwise(0)
    finished = F.lit(True) if today is None else ~too_early & (today >= F.date_add("_issue", period))
    return dated.withColumns(
        {
            "issue_date": F.date_format("_issue", "yyyy-MM-dd"),
            "status": F.when(too_early, "IN_PROGRESS").otherwise("ADJUSTING"),
            "is_done": finished,
            "applies_adjustments": ~too_early & (period > 0),
        }
    ).drop("_today", "_base", "_issue")


def skip_finished(planned: DataFrame, reports: DataFrame) -> DataFrame:
    """A scheduled run makes no new report where a finished one already exists."""
    done = reports.where(F.col("status") == "DONE").select("cost_report_config_id", "report_month").distinct()
    existing = planned.join(done, ["cost_report_config_id", "report_month"], "left_semi").where(F.col("is_done"))
    return planned.join(
        existing.select("cost_report_config_id", "report_month"), ["cost_report_config_id", "report_month"], "left_anti"
    )


def report_base(
    unified: DataFrame, scope: str, workspaces: DataFrame | None = None, sources: DataFrame | None = None, members: DataFrame | None = None
):
    """Unified cost grouped for reports of one scope, three currency sums, all months at once.

    `members` (accounts.config_sources) narrows each config to its sources; the sums are then by config as well.
    """
    keys = [
        *tenant(unified),
        "workspace_id",
        "billed_year",
        "billed_month",
        "exchange_date",
        "usage_type",
        "usage_unit",
        "region_key",
        "region_code",
        *SCOPE_COLUMNS[scope],
    ]
    kept = unified.where(F.col("workspace_id").isNotNull())
    if workspaces is not None:
        kept = kept.join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    if sources is not None:
        kept = kept.join(sources.select("data_source_id"), "data_source_id", "left_semi")
    if members is not None:
        kept, keys = kept.join(members, [*tenant(unified), "data_source_id"]), ["cost_report_config_id", *keys]
    return kept.groupBy(*keys).agg(*[total(F.col(name)).alias(name) for name in currency_columns()])


def _by_config(df: DataFrame) -> list[str]:
    return [name for name in ("domain_id", "cost_report_config_id") if name in df.columns]


def collapse(base: DataFrame, scope: str, by_workspace: bool = False) -> DataFrame:
    """One row per month and scope id: currencies summed, other columns from the first row.

    The first row is the smallest by (region_key, usage_type, usage_unit, ...), so that the
    choice does not depend on the partitioning. `by_workspace` collapses to the workspace for
    every scope.
    """
    ids = [*_by_config(base), "billed_year", "billed_month", "exchange_date"]
    ids += ["workspace_id"] if by_workspace else SCOPE_IDS[scope]
    rest = [
        name
        for name in ("region_key", "usage_type", "usage_unit", "region_code", *SCOPE_COLUMNS[scope])
        if name not in ids
    ]
    first = F.min(F.struct(*rest)).alias("_first")
    sums = [F.sum(name).alias(name) for name in currency_columns()]
    return base.groupBy(*ids).agg(first, *sums).select(*ids, "_first.*", *currency_columns())


def build_reports(collapsed: DataFrame, planned: DataFrame, scope: str) -> DataFrame:
    """Report rows of one scope: join each month to the planned runs of that month, of its tenant and config where these are known."""
    keys = [*_by_config(collapsed), "billed_month"]
    runs = planned.where(F.col("scope") == scope).select(
        *tenant(collapsed), "cost_report_config_id", "scope", "currency", "issue_date", "status", "is_done", "applies_adjustments",
        F.col("report_month").alias("billed_month"),
    )
    rows = collapsed.join(runs, keys)
    return rows.withColumns(
        {
            "name": F.coalesce(F.col(SCOPE_NAMES[scope]), F.lit("Unknown")),
            "report_month": F.col("billed_month"),
            "report_year": F.col("billed_year"),
            "currency_date": F.col("exchange_date"),
            "bank_name": F.lit(DEFAULT_EXCHANGE_SOURCE),
            "cost_report_id": F.concat_ws(
                ":", "cost_report_config_id", "billed_month", *[F.coalesce(F.col(i), F.lit("-")) for i in SCOPE_IDS[scope]]
            ),
        }
    ).drop("billed_month", "billed_year", "exchange_date")


def number_reports(reports: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`CostReport_yymmdd` and a four-digit index per issue date, after the reports already there."""
    within = (*tenant(reports), "issue_date")
    if existing is None:
        numbered = reports.withColumn("_taken", F.lit(0).cast("long"))
    else:
        taken = existing.groupBy(*within).agg(F.count("*").alias("_taken"))
        numbered = lookup(reports, taken, list(within)).na.fill(0, ["_taken"])
    numbered = number_rows(numbered, ["cost_report_id"], "_index", within)
    index = (F.col("_index") + F.col("_taken")).cast("string")
    # Wider indexes keep all their digits.
    padded = F.when(F.length(index) < 4, F.lpad(index, 4, "0")).otherwise(index)
    day = F.date_format(F.to_date("issue_date"), "yyMMdd")
    return numbered.withColumn("report_number", F.concat(F.lit("CostReport_"), day, padded)).drop("_index", "_taken")


def report_lines(unified: DataFrame, reports: DataFrame, scope: str = "WORKSPACE", members: DataFrame | None = None) -> DataFrame:
    """Detail lines of each report's scope and month, with the report's descriptive columns; of its config's sources, given `members`."""
    keys = [
        *tenant(unified),
        "billed_month",
        "workspace_id",
        "project_id",
        "service_account_id",
        "data_source_id",
        "product",
        "provider",
    ]
    lines = unified.groupBy(*keys).agg(*[total(F.col(name)).alias(name) for name in currency_columns()])
    own = [*tenant(unified), *SCOPE_IDS[scope], "report_month"]
    named = ["cost_report_config_id"]
    if members is not None:
        lines, own, named = lines.join(members, [*tenant(unified), "data_source_id"]), ["cost_report_config_id", *own], []
    heads = reports.select(
        *own,
        *named,
        "cost_report_id",
        "report_year",
        "issue_date",
        "currency_date",
        "usage_type",
        "usage_unit",
        "region_key",
        "region_code",
    )
    lines = lines.withColumnRenamed("billed_month", "report_month")
    joined = join_null_safe(lines, heads, own, "inner")
    return joined.withColumns(
        {
            "report_adjustment_policy_id": F.lit(None).cast("string"),
            "is_adjusted": F.lit(False),
            "is_confirmed": F.lit(False),
        }
    )


def with_line_names(
    lines: DataFrame, workspaces: DataFrame, projects: DataFrame, service_accounts: DataFrame
) -> DataFrame:
    """Names on report lines; unknown projects and service accounts get an empty name."""
    own = tenant(lines)
    ws = workspaces.select(*own, "workspace_id", F.col("name").alias("workspace_name"))
    pj = projects.select(*own, "workspace_id", "project_id", F.col("name").alias("project_name"))
    sa = service_accounts.select(*own, "workspace_id", "service_account_id", F.col("name").alias("service_account_name"))
    named = lookup(lines, ws, [*own, "workspace_id"])
    named = lookup(named, pj, [*own, "workspace_id", "project_id"])
    named = lookup(named, sa, [*own, "workspace_id", "service_account_id"])
    return named.na.fill("", ["project_name", "service_account_name"])


def adjusted_totals(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """Total per report over its lines. A report narrowed to a project or service account counts only
    lines of it; reports without lines get 0."""
    ids = [name for name in ("project_id", "service_account_id") if name in reports.columns]
    sums = [total(F.col(name)).alias(name) for name in currency_columns()]
    heads = reports.drop(*currency_columns())
    reduced = lines.groupBy("cost_report_id", *ids).agg(*sums)
    for name in ids:
        reduced = reduced.withColumnRenamed(name, f"_line_{name}")
    joined = reduced.join(heads.select("cost_report_id", *ids), "cost_report_id")
    own = all_of([F.col(name).isNull() | F.col(name).eqNullSafe(F.col(f"_line_{name}")) for name in ids])
    totals = joined.where(own).groupBy("cost_report_id").agg(*sums)
    return heads.join(totals, "cost_report_id", "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(0)) for name in currency_columns()}
    )


def finish(reports: DataFrame) -> DataFrame:
    """Reports due are DONE."""
    due = F.col("is_done") & (F.col("status") == "ADJUSTING")
    return reports.withColumn("status", F.when(due, "DONE").otherwise(F.col("status")))


def confirm_lines(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Lines of finished reports are confirmed."""
    done = reports.where(F.col("status") == "DONE").select("cost_report_id", F.lit(True).alias("_done"))
    joined = lookup(lines, done, ["cost_report_id"])
    confirmed = F.col("is_confirmed") | F.coalesce("_done", F.lit(False))
    return joined.withColumn("is_confirmed", confirmed).drop("_done")


def expire_reports(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """After a run: older finished reports of its month become EXPIRED, older unfinished ones go.

    `runs` has one row per config and month with `run_at`. Finished reports expire as soon as any
    finished report of that month exists, so an older DONE row always does.
    """
    keys = ["cost_report_config_id", "report_month"]
    joined = lookup(reports, runs.select(*keys, "run_at"), keys)
    older = F.coalesce(F.col("created_at") < F.col("run_at"), F.lit(False))
    kept = joined.where(~older | F.col("status").isin("DONE", "EXPIRED"))
    return kept.withColumn(
        "status", F.when(older & (F.col("status") == "DONE"), "EXPIRED").otherwise(F.col("status"))
    ).drop("run_at")


def drop_orphan_lines(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Lines whose report was removed go with it."""
    return keep_matching(lines, reports.select("cost_report_id"), "cost_report_id")


def expire_stored(reports: FactTable, lines: FactTable, runs: DataFrame) -> tuple[FactTable, FactTable]:
    """Stored reports and lines, both by report month, after runs: as `expire_reports` and `drop_orphan_lines` have them.

    Only the months of the runs are read and written. Lines go after their reports; a run that is repeated finds nothing to do.
    """
    months = [(row.report_month,) for row in runs.select("report_month").distinct().collect()]  # bounded by the calendar
    asked = in_partitions(months, ["report_month"])
    before = reports.read(asked)
    after = expire_reports(before, runs)
    moved = before.groupBy("status").count().exceptAll(after.groupBy("status").count())
    if not moved.isEmpty():
        reports = reports.replace(months, after)
    held = lines.read(asked)
    kept = drop_orphan_lines(held, reports.read(asked))
    if held.count() > kept.count():
        lines = lines.replace(months, kept)
    return reports, lines
