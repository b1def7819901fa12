import pytest
from conftest import rows
from pyspark.sql import functions as F

from spendframe.operators import budgets

BUDGET = (
    "budget_id string, name string, workspace_id string, project_id string, service_account_id string, "
    "start string, end string, time_unit string, limit double, currency string, state string, "
    "planned_limits array<struct<date:string,limit:double>>, "
    "plans array<struct<threshold:double,unit:string,notified:boolean>>"
)
UNIFIED = (
    "workspace_id string, project_id string, service_account_id string, billed_month string, "
    "cost_KRW decimal(20,4), cost_USD decimal(20,4), cost_JPY decimal(20,4)"
)


def budget(budget_id, workspace="w", project="p", account=None, unit="TOTAL", limit=100.0, currency="USD",
           start="2024-01", end="2024-03", planned=(), plans=(), state="ACTIVE"):
    return (budget_id, budget_id, workspace, project, account, start, end, unit, limit, currency, state,
            list(planned), list(plans))


@pytest.fixture(scope="module")
def unified(spark):
    from decimal import Decimal

    def line(workspace, project, account, month, usd):
        return (workspace, project, account, month, Decimal(usd * 1000), Decimal(usd), Decimal(usd * 100))

    return spark.createDataFrame(
        [
            line("w", "p", "sa1", "2024-01", 10),
            line("w", "p", "sa2", "2024-01", 5),
            line("w", "q", "sa1", "2024-02", 7),
            line("w", None, None, "2024-02", 1),
            line("v", "p", None, "2024-03", 100),
            line(None, "p", None, "2024-03", 1000),
            line("w", "p", "sa1", "2024-04", 50),
        ],
        UNIFIED,
    )


def test_scope_of_a_budget(spark, unified):
    several = spark.createDataFrame(
        [
            budget("project"),
            budget("account", account="sa1"),
            budget("workspace", project=None),
            budget("everywhere", workspace=None),
            budget("all", workspace=None, project=None),
            budget("yen", currency="JPY"),
        ],
        BUDGET,
    )
    out = budgets.budget_cost(several, unified).select("budget_id", "billed_month", F.col("cost").cast("double"))
    assert rows(out) == [
        ("account", "2024-01", 10.0),
        # A service-account budget ignores its project.
        ("account", "2024-02", 7.0),
        ("all", "2024-01", 15.0),
        ("all", "2024-02", 8.0),
        ("all", "2024-03", 1100.0),
        ("everywhere", "2024-01", 15.0),
        ("everywhere", "2024-03", 1100.0),
        ("project", "2024-01", 15.0),
        ("workspace", "2024-01", 15.0),
        ("workspace", "2024-02", 8.0),
        ("yen", "2024-01", 1500.0),
    ]


PLAN = [("2024-01", 20.0), ("2024-02", 0.0), ("2024-03", 40.0)]
ALERTS = [(50.0, "PERCENT", False), (75.0, "PERCENT", True), (15.0, "PERCENT", False)]


def test_usage_utilisation_and_alerts(spark, unified):
    several = spark.createDataFrame(
        [
            budget("total", plans=ALERTS),
            budget("monthly", unit="MONTHLY", planned=PLAN, plans=ALERTS),
            budget("zero", limit=0.0, plans=ALERTS),
        ],
        BUDGET,
    )
    usage = budgets.budget_usage(several, unified)
    assert rows(usage.where("budget_id = 'monthly'").select("date", "limit", F.col("cost").cast("double"))) == [
        ("2024-01", 20.0, 15.0),
        ("2024-02", 0.0, 0.0),
        ("2024-03", 40.0, 0.0),
    ]
    january = budgets.utilization(several, usage, "2024-01")
    assert rows(january, "budget_id", "utilization_rate") == [("monthly", 75.0), ("total", 15.0), ("zero", None)]
    february = budgets.utilization(several, usage, "2024-02")
    assert ("monthly", None) in rows(february, "budget_id", "utilization_rate")
    # Strictly above: 75 does not fire at 75 (and is notified), 15 does not fire at 15.
    fired = budgets.alerts(several, usage, "2024-01")
    assert rows(fired, "budget_id", "threshold") == [("monthly", 15.0), ("monthly", 50.0)]
    assert budgets.alerts(several, usage, "2024-04").isEmpty()
    marked = budgets.mark_notified(several, fired)
    flags = {row.budget_id: [plan.notified for plan in row.plans] for row in marked.collect()}
    assert flags == {"total": [False, True, False], "monthly": [True, True, True], "zero": [False, True, False]}


def test_state_expiry_and_reset(spark, unified):
    several = spark.createDataFrame(
        [
            budget("old", end="2023-12", start="2023-01"),
            budget("now", unit="MONTHLY", planned=PLAN, plans=ALERTS),
            budget("next", unit="MONTHLY", start="2024-05", end="2024-06", plans=ALERTS),
        ],
        BUDGET,
    )
    assert rows(several.select("budget_id", budgets.state("2024-02"))) == [
        ("next", "SCHEDULED"), ("now", "ACTIVE"), ("old", "EXPIRED")
    ]
    assert rows(budgets.expire(several, "2024-02"), "budget_id", "state") == [
        ("next", "ACTIVE"), ("now", "ACTIVE"), ("old", "EXPIRED")
    ]
    reset = budgets.month_reset(several, budgets.budget_usage(several, unified), "2024-01")
    assert rows(reset, "budget_id", "limit", "utilization_rate", "state") == [
        ("next", 0.0, 0.0, "SCHEDULED"), ("now", 20.0, 75.0, "ACTIVE")
    ]
    assert all(not plan.notified for row in reset.collect() for plan in row.plans)


def test_overlap_depends_on_the_target(spark):
    several = spark.createDataFrame(
        [
            budget("a", start="2024-01", end="2024-03"),
            budget("b", start="2024-03", end="2024-05"),
            budget("c", start="2024-06", end="2024-07"),
            budget("d", account="sa", start="2024-07", end="2024-08"),
            budget("e", account="sb", start="2024-07", end="2024-08"),
            budget("f", workspace="v", start="2024-01", end="2024-12"),
        ],
        BUDGET,
    )
    # c conflicts with the account budgets of its project, they do not conflict with it.
    assert rows(budgets.overlapping(several), "budget_id", "shared_months") == [("a", 1), ("b", 1), ("c", 1)]


def test_plan_problems(spark):
    def plan(*items):
        return budget("x", unit="MONTHLY", planned=items)

    good = [("2024-01", 1.0), ("2024-02", 1.0), ("2024-03", 0.0)]
    cases = [good, good[:2], good + [("2024-04", 1.0)], [("2024-01", -1.0)] + good[1:]]
    several = spark.createDataFrame([(f"b{i}", *plan(*case)[1:]) for i, case in enumerate(cases)], BUDGET)
    long = spark.createDataFrame([budget("long", unit="MONTHLY", start="2023-01", end="2025-01"),
                                  budget("one", unit="MONTHLY", start="2024-01", end="2024-01", planned=good[:1])], BUDGET)
    found = budgets.plan_problems(several.union(long))
    assert rows(found, "budget_id", "missing_months", "extra_months", "negative_limits", "bad_span") == [
        ("b1", 1, 0, 0, False), ("b2", 0, 1, 0, False), ("b3", 0, 0, 1, False), ("long", 25, 0, 0, True),
        ("one", 0, 0, 0, True),
    ]
