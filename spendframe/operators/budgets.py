"""Budget months, usage against unified cost, utilisation, alerts and checks.

`as_of` is the current month (YYYY-MM), a Column or a string.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.money import currency_columns, total
from spendframe.functions.periods import months_between
from spendframe.functions.predicates import definitely
from spendframe.operators.lookups import join_null_safe
from spendframe.session import durable
from spendframe.sources.facts import FactTable

def _month(as_of) -> Column:
    return F.lit(as_of) if isinstance(as_of, str) else as_of


def expand_usage(budgets: DataFrame) -> DataFrame:
    """One row per budget month. TOTAL budgets get every month with limit 0, MONTHLY ones their plan."""
    every_month = F.transform(
        months_between(F.col("start"), F.col("end")),
        lambda month: F.struct(month.alias("date"), F.lit(0).cast("double").alias("limit")),
    )
    months = F.when(F.col("time_unit") == "TOTAL", every_month).otherwise(F.col("planned_limits"))
    ids = ["budget_id", "name", "currency", "workspace_id", "project_id", "service_account_id"]
    return budgets.select(*ids, F.lit(0).cast("double").alias("cost"), F.inline(months))


SCOPE = ["_kind", "_target", "_workspace"]


def _with_scope(budgets: DataFrame) -> DataFrame:
    """What a budget measures: a service account, else a project, else everything, in its workspace
    or in all of them."""
    kind = (
        F.when(F.col("service_account_id").isNotNull(), "SERVICE_ACCOUNT")
        .when(F.col("project_id").isNotNull(), "PROJECT")
        .otherwise("ALL")
    )
    target = F.coalesce("service_account_id", "project_id")
    return budgets.withColumns({"_kind": kind, "_target": target, "_workspace": F.col("workspace_id")})


def _scopes_of_cost() -> Column:
    """All scopes a cost row counts for. A row without a workspace lists some twice, hence the set."""
    nothing = F.lit(None).cast("string")
    targets = {
        "SERVICE_ACCOUNT": F.col("service_account_id"),
        "PROJECT": F.col("project_id"),
        "ALL": nothing,
    }
    scopes = [
        F.struct(F.lit(kind).alias("_kind"), target.alias("_target"), workspace.alias("_workspace"))
        for kind, target in targets.items()
        for workspace in (F.col("workspace_id"), nothing)
    ]
    return F.filter(
        F.array_distinct(F.array(*scopes)),
        lambda scope: (scope["_kind"] == "ALL") | scope["_target"].isNotNull(),
    )


def budget_cost(budgets: DataFrame, unified: DataFrame) -> DataFrame:
    """Cost of each budget per month with cost, within [start, end], in the budget's currency.

    Unified cost is first reduced to one row per workspace, project, service account and month.
    Each of these rows then counts for the scopes that can contain it, which turns the
    conditional match into one equality join.
    """
    amounts = currency_columns()
    # No budget looks outside this span, so other months are not even read.
    first, last = (budgets.agg(bound).scalar() for bound in (F.min("start"), F.max("end")))
    unified = unified.where((F.col("billed_month") >= first) & (F.col("billed_month") <= last))
    sums = [total(F.col(name)).alias(name) for name in amounts]
    reduced = unified.groupBy("workspace_id", "project_id", "service_account_id", "billed_month").agg(*sums)
    scoped = _with_scope(budgets).select("budget_id", "currency", "start", "end", *SCOPE)
    spread = reduced.select("billed_month", *amounts, F.inline(_scopes_of_cost()))
    # Summed before the join: the scope of everything, which all rows count for, is combined before it is shuffled.
    per_scope = spread.groupBy(*SCOPE, "billed_month").agg(*sums)
    matched = join_null_safe(scoped, per_scope, SCOPE, "inner").where(
        F.col("billed_month").between(F.col("start"), F.col("end"))
    )
    amount = F.coalesce(*[F.when(F.col("currency") == name[-3:], F.col(name)) for name in amounts])
    return matched.select("budget_id", "billed_month", amount.alias("cost"))


def budget_usage(budgets: DataFrame, unified: DataFrame) -> DataFrame:
    """Every budget month with its cost, 0 where there is none."""
    costs = budget_cost(budgets, unified).select(
        "budget_id", F.col("billed_month").alias("date"), F.col("cost").alias("_cost")
    )
    usage = expand_usage(budgets).drop("cost").join(costs, ["budget_id", "date"], "left")
    return usage.withColumn("cost", F.coalesce("_cost", F.lit(0))).drop("_cost")


def usage_and_limit(budgets: DataFrame, usage: DataFrame, as_of) -> DataFrame:
    """Cost and limit to judge a budget by: the whole span for TOTAL, the current month for MONTHLY."""
    now = F.col("date") == _month(as_of)
    sums = usage.groupBy("budget_id").agg(
        total(F.col("cost")).alias("_all"),
        total(F.when(now, F.col("cost"))).alias("_now"),
        F.max(F.when(now, F.col("limit"))).alias("_now_limit"),
        F.max(now).alias("_has_now"),
    )
    is_total = F.col("time_unit") == "TOTAL"
    return (
        budgets.join(sums, "budget_id", "left")
        .withColumns(
            {
                "usage": F.round(F.coalesce(F.when(is_total, F.col("_all")).otherwise(F.col("_now")), F.lit(0)), 2),
                "usage_limit": F.coalesce(
                    F.when(is_total, F.col("limit")).otherwise(F.col("_now_limit")), F.lit(0)
                ),
                "_exact": F.when(is_total, F.col("_all")).otherwise(F.col("_now")).cast("double"),
                "_judged": is_total | F.coalesce("_has_now", F.lit(False)),
            }
        )
        .drop("_all", "_now", "_now_limit", "_has_now")
    )


def utilization(budgets: DataFrame, usage: DataFrame, as_of) -> DataFrame:
    """Percentage used, two digits. No limit, or no usage row for the current month, gives null."""
    judged = usage_and_limit(budgets, usage, as_of)
    rate = F.round(F.col("_exact") / F.nullif(F.col("usage_limit"), F.lit(0.0)) * 100, 2)
    return judged.withColumn("utilization_rate", F.when(F.col("_judged"), rate)).drop("_exact", "_judged")


def alerts(budgets: DataFrame, usage: DataFrame, as_of) -> DataFrame:
    """Plans that fire now: percent plans not notified yet whose threshold is strictly exceeded."""
    rated = utilization(budgets, usage, as_of)
    running = (_month(as_of) <= F.col("end")) & (F.col("usage_limit") != 0)
    plans = rated.where(running).select(
        "budget_id", "workspace_id", "utilization_rate", "usage", "usage_limit", F.inline("plans")
    )
    fires = (F.col("unit") == "PERCENT") & ~F.col("notified") & (F.col("utilization_rate") > F.col("threshold"))
    return plans.where(definitely(fires))


def mark_notified(budgets: DataFrame, fired: DataFrame) -> DataFrame:
    """Set the flag on the fired plans and keep all others as they are."""
    hits = fired.groupBy("budget_id").agg(F.collect_set("threshold").alias("_fired"))
    flagged = F.transform(
        "plans",
        lambda plan: plan.withField(
            "notified", plan["notified"] | F.coalesce(F.array_contains("_fired", plan["threshold"]), F.lit(False))
        ),
    )
    return budgets.join(hits, "budget_id", "left").withColumn("plans", flagged).drop("_fired")


def notify(stored: FactTable, usage: DataFrame, as_of) -> tuple[FactTable, DataFrame]:
    """The stored budgets with the flags of plans that fire now, and these plans. Run again, nothing fires and nothing is written."""
    budgets = stored.read()
    fired = durable(alerts(budgets, usage, as_of), "alerts")
    told = mark_notified(budgets.join(fired.select("budget_id").distinct(), "budget_id", "left_semi"), fired)
    return stored.merge(told, ["budget_id"]), fired


def reset_month(stored: FactTable, usage: DataFrame, as_of) -> FactTable:
    """The stored budgets after the start of a month; those that `month_reset` leaves alone stay as they are."""
    reset = month_reset(stored.read(), usage, as_of)
    return stored.merge(reset.select(*stored.schema.names), ["budget_id"])


def state(as_of) -> Column:
    now = _month(as_of)
    return F.when(now > F.col("end"), "EXPIRED").when(now < F.col("start"), "SCHEDULED").otherwise("ACTIVE")


def expire(budgets: DataFrame, as_of) -> DataFrame:
    """Move budgets whose last month has passed to EXPIRED; all others keep their state."""
    ended = (F.col("end") < _month(as_of)) & (F.col("state") != "EXPIRED")
    return budgets.withColumn("state", F.when(ended, state(as_of)).otherwise(F.col("state")))


def month_reset(budgets: DataFrame, usage: DataFrame, as_of) -> DataFrame:
    """Start of a month for running MONTHLY budgets: limit from the plan, flags cleared, rate unrounded."""
    now = _month(as_of)
    running = (F.col("time_unit") == "MONTHLY") & (F.col("end") >= now)
    planned = F.filter("planned_limits", lambda item: item["date"] == now)
    limit = F.coalesce(F.try_element_at(planned, F.lit(1))["limit"], F.lit(0.0))
    current = usage.where(F.col("date") == now).groupBy("budget_id").agg(F.max("cost").alias("_cost"))
    reset = budgets.where(running).join(current, "budget_id", "left").withColumn("limit", limit)
    rate = F.col("_cost").cast("double") / F.nullif(F.col("limit"), F.lit(0.0)) * 100
    return reset.withColumns(
        {
            "utilization_rate": F.coalesce(rate, F.lit(0.0)),
            "plans": F.transform("plans", lambda plan: plan.withField("notified", F.lit(False))),
            "state": state(now),
        }
    ).drop("_cost")


def overlapping(budgets: DataFrame) -> DataFrame:
    """Budgets whose span overlaps another budget of the same target, with the shared months.

    Two spans overlap exactly when they share a month, so counting budgets per target and month
    finds every conflict without pairing budgets. A service-account budget conflicts with
    budgets of that account, a project budget with every budget inside the project.
    """
    ids = ["workspace_id", "project_id", "service_account_id"]
    months = budgets.select(
        "budget_id", *ids, "start", "end", F.explode(months_between(F.col("start"), F.col("end"))).alias("_month")
    )
    per_account = months.groupBy(*ids, "_month").agg(F.count("*").alias("_in_account"))
    per_project = per_account.groupBy("workspace_id", "project_id", "_month").agg(
        F.sum("_in_account").alias("_in_project")
    )
    counted = join_null_safe(months, per_account, [*ids, "_month"], "inner")
    counted = join_null_safe(counted, per_project, ["workspace_id", "project_id", "_month"], "inner")
    rivals = F.when(F.col("service_account_id").isNull(), F.col("_in_project")).otherwise(F.col("_in_account"))
    return (
        counted.where(rivals > 1)
        .groupBy("budget_id", *ids, "start", "end")
        .agg(F.count("*").alias("shared_months"))
    )


def plan_problems(budgets: DataFrame) -> DataFrame:
    """Monthly plans that are not valid: months missing or outside the span, negative limits, bad span."""
    wanted = months_between(F.col("start"), F.col("end"))
    planned = F.transform("planned_limits", lambda item: item["date"])
    years = F.substring("end", 1, 4).cast("int") - F.substring("start", 1, 4).cast("int")
    checked = budgets.where(F.col("time_unit") == "MONTHLY").withColumns(
        {
            "missing_months": F.size(F.array_except(wanted, planned)),
            "extra_months": F.size(F.array_except(planned, wanted)),
            "negative_limits": F.size(F.filter("planned_limits", lambda item: item["limit"] < 0)),
            "bad_span": (F.col("start") >= F.col("end")) | (years > 1),
        }
    )
    wrong = (F.col("missing_months") + F.col("extra_months") + F.col("negative_limits") > 0) | F.col("bad_span")
    return checked.where(wrong)


def check_thresholds(budgets: DataFrame) -> DataFrame:
    """Plans sorted by threshold, and the first thing wrong with them (null when they are fine)."""
    thresholds = F.transform("plans", lambda plan: plan["threshold"])
    problem = (
        F.when(F.exists("plans", lambda plan: plan["unit"] != "PERCENT"), "unit")
        .when(F.exists("plans", lambda plan: (plan["threshold"] < 0) | (plan["threshold"] > 100)), "range")
        .when(F.size(F.array_distinct(thresholds)) < F.size(thresholds), "duplicate")
    )
    by_threshold = F.transform(
        F.array_sort(F.transform("plans", lambda plan: F.struct(plan["threshold"].alias("t"), plan.alias("p")))),
        lambda pair: pair["p"],
    )
    return budgets.withColumns({"problem": problem, "plans": by_threshold})


def recipients(
    budgets: DataFrame, service_accounts: DataFrame, role_bindings: DataFrame, users: DataFrame
) -> DataFrame:
    """Users to alert per budget.

    Candidates are the listed users, the budget manager and the managers of the measured service
    accounts, as switched on per budget. They, and holders of a listed role type, need a role
    binding in the workspace and a verified mail address.
    """
    listed = budgets.select("budget_id", "workspace_id", F.explode("users").alias("user_id"))
    managers = budgets.where("budget_manager_notification = 'ENABLED' and budget_manager_id is not null").select(
        "budget_id", "workspace_id", F.col("budget_manager_id").alias("user_id")
    )
    watched = budgets.where("service_account_manager = 'ENABLED'")
    owners = service_accounts.where(F.col("service_account_mgr_id").isNotNull()).select(
        "workspace_id", "project_id", "service_account_id", F.col("service_account_mgr_id").alias("user_id")
    )
    of_account = watched.where(F.col("service_account_id").isNotNull()).join(
        owners.drop("project_id"), ["workspace_id", "service_account_id"]
    )
    of_project = watched.where(F.col("service_account_id").isNull()).join(
        owners.drop("service_account_id"), ["workspace_id", "project_id"]
    )
    named = [frame.select("budget_id", "workspace_id", "user_id") for frame in (listed, managers, of_account, of_project)]
    candidates = named[0].union(named[1]).union(named[2]).union(named[3]).distinct()
    bound = candidates.join(role_bindings.select("workspace_id", "user_id").distinct(), ["workspace_id", "user_id"])
    by_role = budgets.select("budget_id", "workspace_id", F.explode("role_types").alias("role_type")).join(
        role_bindings.select("workspace_id", "role_type", "user_id"), ["workspace_id", "role_type"]
    )
    chosen = bound.select("budget_id", "user_id").union(by_role.select("budget_id", "user_id")).distinct()
    verified = users.where(F.col("email_verified")).select(
        "user_id", "email", F.coalesce("language", F.lit("en")).alias("language")
    )
    return chosen.join(verified, "user_id")
