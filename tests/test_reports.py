from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spendframe.operators import adjustments, fx, reports
from spendframe.schema import DEFAULT_RATES

CONFIG = "cost_report_config_id string, issue_day int, is_last_day boolean, adjustment_enabled boolean, adjustment_period int, as_of string"


def plan(spark, as_of, day=10, last=False, enabled=False, period=0):
    df = spark.createDataFrame([("c", day, last, enabled, period, as_of)], CONFIG)
    row = reports.calendar(df, F.col("as_of")).collect()[0]
    return row.report_month, row.issue_date, row.status, row.is_done


def test_calendar(spark):
    assert plan(spark, "2024-03-09") == ("2024-02", "2024-03-10", "IN_PROGRESS", False)
    assert plan(spark, "2024-03-10") == ("2024-02", "2024-03-10", "ADJUSTING", True)
    # Within the first retry days the run still belongs to the month before.
    assert plan(spark, "2024-03-07") == ("2024-01", "2024-02-10", "ADJUSTING", True)
    assert plan(spark, "2024-03-08") == ("2024-02", "2024-03-10", "IN_PROGRESS", False)
    assert plan(spark, "2024-02-29", day=31) == ("2024-01", "2024-02-29", "ADJUSTING", True)
    assert plan(spark, "2024-03-12", enabled=True, period=3) == ("2024-02", "2024-03-10", "ADJUSTING", False)
    assert plan(spark, "2024-03-13", enabled=True, period=3) == ("2024-02", "2024-03-10", "ADJUSTING", True)
    # A period without adjustments switched on does not delay.
    assert plan(spark, "2024-03-10", enabled=False, period=3)[3] is True
    assert plan(spark, "2024-04-20", last=True) == ("2024-03", "2024-04-30", "IN_PROGRESS", False)


def test_regenerate_clamps_the_issue_day(spark):
    df = spark.createDataFrame([("c", 31, False, True, 3, "")], CONFIG)
    row = reports.calendar_regenerate(df, F.lit("2024-01")).collect()[0]
    assert (row.report_month, row.issue_date, row.status, row.is_done) == ("2024-01", "2024-02-29", "ADJUSTING", True)


def test_scheduled_run_skips_finished_months(spark):
    planned = spark.createDataFrame(
        [("c", "2024-01", True), ("c", "2024-02", False), ("d", "2024-01", True)],
        "cost_report_config_id string, report_month string, is_done boolean",
    )
    stored = spark.createDataFrame(
        [("c", "2024-01", "DONE"), ("c", "2024-02", "DONE"), ("d", "2024-01", "IN_PROGRESS")],
        "cost_report_config_id string, report_month string, status string",
    )
    kept = reports.skip_finished(planned, stored)
    assert rows(kept, "cost_report_config_id", "report_month") == [("c", "2024-02"), ("d", "2024-01")]


def test_expiry_and_orphan_lines(spark):
    stored = spark.createDataFrame(
        [
            ("r1", "c", "m", "DONE", 1), ("r2", "c", "m", "IN_PROGRESS", 1), ("r3", "c", "m", "DONE", 5),
            ("r4", "c", "m", "EXPIRED", 0), ("r5", "c", "n", "IN_PROGRESS", 0), ("r6", "c", "m", "ADJUSTING", 5),
        ],
        "cost_report_id string, cost_report_config_id string, report_month string, status string, created_at int",
    )
    runs = spark.createDataFrame([("c", "m", 5)], "cost_report_config_id string, report_month string, run_at int")
    kept = reports.expire_reports(stored, runs)
    assert rows(kept, "cost_report_id", "status") == [
        ("r1", "EXPIRED"), ("r3", "DONE"), ("r4", "EXPIRED"), ("r5", "IN_PROGRESS"), ("r6", "ADJUSTING")
    ]
    lines = spark.createDataFrame([("r1", 1), ("r2", 2)], "cost_report_id string, n int")
    assert rows(reports.drop_orphan_lines(lines, kept)) == [("r1", 1)]


def test_numbers_continue_after_existing_and_keep_wide_indexes(spark):
    new = spark.createDataFrame([("b", "2024-03-10"), ("a", "2024-03-10"), ("c", "2024-04-10")], "cost_report_id string, issue_date string")
    old = spark.range(9999).select(F.lit("2024-03-10").alias("issue_date"))
    out = reports.number_reports(new, old)
    assert rows(out, "cost_report_id", "report_number") == [
        ("a", "CostReport_24031010000"), ("b", "CostReport_24031010001"), ("c", "CostReport_2404100001")
    ]


REPORT = (
    "cost_report_id string, cost_report_config_id string, workspace_id string, project_id string, report_month string, "
    "report_year string, issue_date string, currency_date string, usage_type string, usage_unit string, region_key string, "
    "region_code string, applies_adjustments boolean"
)


@pytest.fixture(scope="module")
def heads(spark):
    def head(name, workspace, project=None, applies=True):
        return (name, "c", workspace, project, "2024-02", "2024", "2024-03-10", "2024-03-01", None, None, None, None, applies)

    return spark.createDataFrame([head("r1", "w1"), head("r2", "w2", "p2"), head("r3", "w1", None, False)], REPORT)


@pytest.fixture(scope="module")
def lines(spark, heads):
    amounts = spark.createDataFrame(
        [("r1", "aws", "ec2", 100), ("r1", "gcp", "gce", 50), ("r2", "gcp", "gce", 10), ("r3", "aws", "ec2", 1)],
        "cost_report_id string, provider string, product string, usd int",
    )
    usd = F.col("usd").cast("decimal(38,12)")
    return heads.drop("applies_adjustments").join(amounts, "cost_report_id").select(
        "*",
        F.lit(None).cast("string").alias("service_account_id"),
        F.lit("ds").alias("data_source_id"),
        F.lit(None).cast("string").alias("report_adjustment_policy_id"),
        (usd * 1000).cast("decimal(38,12)").alias("cost_KRW"),
        usd.alias("cost_USD"),
        (usd * 100).cast("decimal(38,12)").alias("cost_JPY"),
        F.lit(False).alias("is_adjusted"),
        F.lit(False).alias("is_confirmed"),
    ).drop("usd")


@pytest.fixture(scope="module")
def rates(spark):
    dates = spark.sql("select date'2024-03-01' as as_of")
    quotes = spark.sql("select date'2000-01-01' as date, 'USD' as from_currency, 'KRW' as to_currency, 1.0 as close")
    return fx.with_defaults(fx.asof_rates_for(dates, quotes), dates)


def policy(name, order, *steps, scope="WORKSPACE", **ids):
    return {"report_adjustment_policy_id": name, "scope": scope, "order": order, "policy_filter": ids, "adjustments": list(steps)}


def percent(name, value, order=1, provider=None, where=()):
    return {"name": name, "unit": "PERCENT", "value": value, "order": order, "provider": provider, "adjustment_filter": list(where)}


def added(heads, lines, policies, rates):
    out = adjustments.adjustment_lines(heads, lines, policies, rates)
    return rows(out.select("cost_report_id", "product", F.col("cost_USD").cast("double")))


def test_percent_sees_earlier_policies_but_not_its_own(heads, lines, rates):
    policies = [
        policy("second", 2, percent("On top", 50)),
        policy("first", 1, percent("Ten", 10, order=1), percent("Again", 10, order=2)),
    ]
    assert added(heads, lines, policies, rates) == [
        ("r1", "Again", 15.0), ("r1", "On top", 90.0), ("r1", "Ten", 15.0),
        ("r2", "Again", 1.0), ("r2", "On top", 6.0), ("r2", "Ten", 1.0),
    ]


def test_provider_filter_and_missing_order_last(heads, lines, rates):
    policies = [
        policy("last", None, percent("All", 100)),
        policy("aws", 5, percent("Aws", 10, provider="aws")),
    ]
    # r2 has no aws line, so it gets no line from the first policy.
    assert added(heads, lines, policies, rates) == [("r1", "All", 160.0), ("r1", "Aws", 10.0), ("r2", "All", 10.0)]


def test_adjustment_filter_and_scope(heads, lines, rates):
    only_ec2 = percent("Ec2", 10, where=[{"k": "product", "v": ["ec2"], "o": "in"}])
    assert added(heads, lines, [policy("x", 1, only_ec2)], rates) == [("r1", "Ec2", 10.0)]
    some = policy("x", 1, percent("W2", 10), workspace_ids=["w2"])
    assert added(heads, lines, [some], rates) == [("r2", "W2", 1.0)]
    project = policy("x", 1, percent("P", 10), scope="PROJECT", project_ids=["p2"])
    assert added(heads, lines, [project], rates) == [("r2", "P", 1.0)]
    assert added(heads, lines, [], rates) == []


def test_fixed_amount_is_converted_and_taxed(heads, lines, rates):
    fixed = {"name": "Fee", "unit": "FIXED", "value": 1000, "currency": "KRW", "order": 1, "provider": "aws"}
    policies = [policy("a", 1, fixed), policy("b", 2, percent("Tax", 10, provider="aws"))]
    out = adjustments.adjustment_lines(heads, lines, policies, rates).where("cost_report_id = 'r2'")
    usd = Decimal(str(DEFAULT_RATES["KRW/USD"])) * 1000
    assert rows(out.select("product", "cost_KRW", "cost_USD")) == [
        ("Fee", Decimal("1000.000000"), usd.quantize(Decimal("1e-12"))),
        ("Tax", Decimal("100.000000"), (usd / 10).quantize(Decimal("1e-12"))),
    ]


def test_shares_keep_their_digits(heads, lines, rates):
    """7.12345 % is not rounded to six places, nor are small rates."""
    policies = [policy("a", 1, percent("Share", 7.12345), percent("Tiny", "0.00000001"))]
    out = adjustments.adjustment_lines(heads, lines, policies, rates).where("cost_report_id = 'r1'")
    assert rows(out.select("product", "cost_KRW", "cost_USD")) == [
        ("Share", Decimal("10685.175"), Decimal("10.685175")), ("Tiny", Decimal("0.000015"), Decimal("0.000000015"))
    ]


def test_policies_of_several_configs_from_a_table(spark, heads, lines, rates):
    """Each report gets its config's policies and those of all; filters see the lines added before."""
    two = heads.where("applies_adjustments").withColumn("cost_report_config_id", F.when(F.col("cost_report_id") == "r2", "d").otherwise("c"))
    gcp = {"k": "provider", "v": "gcp", "o": "not"}
    policies = [
        {**policy("of-c", 1, percent("C", 10, provider="aws")), "cost_report_config_id": "c"},
        {**policy("of-d", 1, percent("D", 10, where=[{"k": "product", "v": "GC", "o": "contain"}])), "cost_report_config_id": "d"},
        policy("all", 2, percent("Rest", 100, where=[gcp, {"k": "workspace_id", "v": ["w1", None], "o": "in"}])),
    ]
    assert added(two, lines, adjustments.policy_table(spark, policies), rates) == [("r1", "C", 10.0), ("r1", "Rest", 110.0), ("r2", "D", 1.0)]


def test_the_plan_does_not_grow_with_the_policies(spark, heads, lines, rates):
    def plan(count):
        many = [policy(f"p{i}", i, percent(f"n{i}", 1, provider="aws")) for i in range(count)]
        return adjustments.adjustment_lines(heads, lines, adjustments.policy_table(spark, many), rates)

    sizes = [len(plan(count)._jdf.queryExecution().optimizedPlan().toString()) for count in (3, 60)]
    assert abs(sizes[0] - sizes[1]) < 100
    last = {row.product: row.cost_USD for row in plan(60).where("cost_report_id = 'r1'").collect()}
    assert len(last) == 60 and round(float(last["n59"]), 6) == round(1.01**59, 6)


def test_totals_follow_the_scope(heads, lines, rates):
    adjusted = adjustments.apply_policies(heads, lines, [policy("a", 1, percent("Ten", 10))], rates)
    with_cost = heads.withColumns({f"cost_{c}": F.lit(0) for c in ("KRW", "USD", "JPY")})
    totals = reports.adjusted_totals(with_cost, adjusted)
    assert rows(totals.select("cost_report_id", F.col("cost_USD").cast("double"))) == [("r1", 165.0), ("r2", 11.0), ("r3", 1.0)]
    empty = reports.adjusted_totals(with_cost, adjusted.where("false"))
    assert rows(empty.select("cost_report_id", F.col("cost_USD").cast("double"))) == [("r1", 0.0), ("r2", 0.0), ("r3", 0.0)]


def test_finish_and_confirm(heads, lines):
    due = heads.withColumns({"status": F.lit("ADJUSTING"), "is_done": F.col("cost_report_id") == "r1"})
    finished = reports.finish(due)
    assert rows(finished, "cost_report_id", "status") == [("r1", "DONE"), ("r2", "ADJUSTING"), ("r3", "ADJUSTING")]
    confirmed = reports.confirm_lines(lines, finished)
    assert rows(confirmed.where("is_confirmed"), "cost_report_id") == [("r1",), ("r1",)]
