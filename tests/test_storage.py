"""Sources, sinks, streaming, rates and accounts."""

import json
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spendframe.operators import accounts, fx, retention
from spendframe.operators.analyze import analyze
from spendframe.operators.filters import group_closure, in_workspaces, listed_reports
from spendframe.operators.rollup import monthly_rollup
from spendframe.operators.unified import month_calendar, unify
from spendframe.schema import UNIFIED_KEYS
from spendframe.sources import warehouse
from spendframe.sources.billing import normalise, read_rows, split_valid
from spendframe.streaming.ingest import load_pages, load_pages_in_batches, page_stream

BATCH = {"job_id": "j1", "job_task_id": "t1", "data_source_id": "ds"}


def write_page(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(item) for item in items))


def test_json_rows_checked_and_normalised(spark, tmp_path):
    write_page(
        tmp_path / "in", "1.json",
        {"billed_date": "2024-02-29", "provider": "aws", "region_code": "us", "tags": {"a": "b"}},
        {"billed_date": "2023-02-29", "cost": 1.5},
        {"cost": 2.5},
        {"billed_date": "2024-1-1", "cost": 3.5},
    )
    valid, rejected = split_valid(read_rows(spark, str(tmp_path / "in"), "json"))
    assert rows(rejected, "cost", "reason") == [
        (1.5, "billed_date is not YYYY-MM-DD"), (2.5, "missing billed_date"), (3.5, "billed_date is not YYYY-MM-DD")
    ]
    lines = normalise(valid, {**BATCH, "project_id": "p"})
    names = ["cost", "region_key", "billed_year", "billed_month", "project_id", "workspace_id", "job_id"]
    assert rows(lines, *names) == [(Decimal("0.0000"), "aws.us", "2024", "2024-02", "p", None, "j1")]


def test_stream_loads_every_page_once(spark, tmp_path):
    pages, table, refusals, checkpoint = tmp_path / "pages", *(str(tmp_path / name) for name in ("table", "refused", "check"))
    write_page(pages, "1.json", {"billed_date": "2024-01-01", "cost": 1}, {"cost": 9})
    load_pages(page_stream(spark, str(pages), "json"), BATCH, table, refusals, checkpoint)
    write_page(pages, "2.json", {"billed_date": "2024-02-01", "cost": 2})
    load_pages(page_stream(spark, str(pages), "json"), BATCH, table, refusals, checkpoint)
    load_pages(page_stream(spark, str(pages), "json"), BATCH, table, refusals, checkpoint)
    assert rows(spark.read.parquet(table).selectExpr("billed_month", "cast(cost as double)")) == [("2024-01", 1.0), ("2024-02", 2.0)]
    assert rows(spark.read.parquet(refusals).selectExpr("cast(cost as double)", "reason")) == [(9.0, "missing billed_date")]
    seen, refused = [], []
    load_pages_in_batches(
        page_stream(spark, str(pages), "json"),
        BATCH,
        lambda df, _: seen.append(df.count()),
        lambda df, _: refused.append(df.count()),
        str(tmp_path / "check2"),
    ).awaitTermination()
    assert (sum(seen), sum(refused)) == (2, 1)


FACT = "id int, data_source_id string, billed_month string, job_id string, job_task_id string, provider string"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            (1, "a", "2024-01", "old", "t0", "aws"), (2, "a", "2024-02", "old", "t0", "aws"),
            (3, "a", "2024-02", "new", "t1", "aws"), (4, "a", "2024-03", "old", "t0", "gcp"),
            (5, "b", "2024-02", "old", "t0", "aws"), (6, "a", "2024-04", "new", "t1", "aws"),
            (7, "a", "2024-02", None, None, None),
        ],
        FACT,
    )


def ids(df):
    return [row.id for row in df.orderBy("id").collect()]


def test_replacing_rows_of_other_jobs(facts):
    job = {"job_id": "new", "data_source_id": "a", "changed": [{"start": "2024-02"}]}
    assert ids(retention.survivors(facts, retention.replaced_by_job(job))) == [1, 3, 5, 6]
    job["changed"] = [{"start": "2024-01", "end": "2024-02", "filter": {"provider": "aws"}}]
    assert ids(retention.survivors(facts, retention.replaced_by_job(job))) == [3, 4, 5, 6, 7]
    task = {"job_id": "new", "job_task_id": "t1", "data_source_id": "a", "changed": {"start": "2024-02", "end": None}}
    assert ids(retention.survivors(facts, retention.replaced_by_task(task))) == [1, 3, 5, 6, 7]


def test_retention_bounds(spark):
    months = spark.createDataFrame([("2023-03", "2023"), ("2023-02", "2023"), ("2020-12", "2020")], "billed_month string, billed_year string")
    assert rows(months.where(~retention.outdated_daily("2024-03-15")), "billed_month") == [("2023-03",)]
    assert rows(months.where(~retention.outdated_monthly("2024-03-15")), "billed_year") == [("2023",), ("2023",)]


def quotes(spark, *items):
    return spark.createDataFrame(list(items), "date string, from_currency string, to_currency string, close double").withColumn(
        "date", F.to_date("date")
    )


def test_asof_rates_window_and_fallback(spark):
    found = quotes(
        spark, ("2024-03-01", "USD", "KRW", 1300.0), ("2024-03-05", "USD", "KRW", 1310.0), ("2024-03-09", "USD", "KRW", 1320.0),
        ("2024-02-20", "USD", "JPY", 150.0), ("2024-03-05", "USD", "USD", 5.0), ("2024-03-06", "USD", "KRW", None),
    )
    one = fx.asof_rates(found, "2024-03-06")
    picked = one.selectExpr("to_currency", "cast(rate as double)", "cast(rate_date as string)")
    assert rows(picked) == [("JPY", 150.0, "2024-02-20"), ("KRW", 1310.0, "2024-03-05"), ("USD", 1.0, "2024-03-05")]
    dates = spark.sql("select explode(array(date'2024-03-06', date'2024-03-07')) as as_of")
    several = fx.with_defaults(fx.asof_rates_for(dates, found), dates)
    picked = several.where("from_currency = 'USD'").selectExpr("cast(as_of as string)", "to_currency", "cast(rate as double)")
    assert rows(picked) == [
        ("2024-03-06", "JPY", 150.0), ("2024-03-06", "KRW", 1310.0), ("2024-03-06", "USD", 1.0),
        # The yen quote is 16 days old by then.
        ("2024-03-07", "JPY", 149.73205030286636), ("2024-03-07", "KRW", 1310.0), ("2024-03-07", "USD", 1.0),
    ]
    assert several.count() == 18
    with pytest.raises(ValueError):
        fx.fallback_rates({"USD/KRW": 1.0})


def test_routing_needs_a_routed_source(spark):
    known = spark.createDataFrame(
        [("a", "acc", "real", "v-2"), ("a", "acc", "other", "v-1"), ("b", "acc", "real", "v-3"), ("a", "lone", None, "v-4")],
        "data_source_id string, account_id string, workspace_id string, v_workspace_id string",
    )
    cost = spark.createDataFrame(
        [(1, "a", "acc", "w"), (2, "b", "acc", "w"), (3, "a", "none", "w"), (4, "a", "lone", None)],
        "id int, data_source_id string, account string, workspace_id string",
    )
    out = accounts.route_accounts(cost, known, {"a": "account"})
    assert rows(out, "id", "workspace_id", "real_workspace_id") == [
        (1, "v-1", "other"), (2, "w", "w"), (3, "w", None), (4, "v-4", None)
    ]


def test_linking_falls_back_to_the_only_workspace(spark):
    unlinked = spark.createDataFrame([("x", None, False), ("y", "kept", True)], "account_id string, workspace_id string, is_linked boolean")
    two = spark.createDataFrame([("w2", ["x"]), ("w1", ["x", "z"])], "workspace_id string, references array<string>")
    assert rows(accounts.connect_accounts(unlinked, two), "account_id", "workspace_id", "is_linked") == [("x", "w1", True), ("y", "kept", True)]
    one = two.where("workspace_id = 'w2'")
    assert rows(accounts.connect_accounts(unlinked, one), "account_id", "workspace_id") == [("x", "w2"), ("y", "w2")]


def test_virtual_workspace_filter(spark):
    known = spark.createDataFrame([("w1", "v-1"), ("w1", "v-2"), ("w2", "v-3")], "workspace_id string, v_workspace_id string")
    cost = spark.createDataFrame([(1, "v-1"), (2, "v-3"), (3, "w3"), (4, "w1"), (5, None)], "id int, workspace_id string")
    assert ids(in_workspaces(cost, ["w1", "w3"], known)) == [1, 3]
    assert ids(in_workspaces(cost, ["w1", "w3"], known, negate=True)) == [2, 4, 5]


def test_group_closure_of_a_deep_tree(spark):
    groups = spark.createDataFrame([(f"g{i}", f"g{i - 1}") for i in range(1, 101)], "project_group_id string, parent_group_id string")
    found = group_closure(groups, groups.where("project_group_id = 'g7'"))
    assert rows(found) == sorted((f"g{i}",) for i in range(7, 101))
    root = spark.createDataFrame([("g0",)], "project_group_id string")
    assert group_closure(groups, root).count() == 101


def test_group_closure_stops_on_cycles(spark):
    groups = spark.createDataFrame(
        [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "project_group_id string, parent_group_id string"
    )
    assert rows(group_closure(groups, groups.where("project_group_id = 'b'"))) == [("b",), ("c",), ("d",)]
    assert rows(group_closure(groups, groups.where("project_group_id = 'x'"))) == [("x",), ("y",)]


def test_report_list_default(spark):
    df = spark.createDataFrame([(1, "DONE"), (2, "EXPIRED")], "id int, status string")
    assert ids(listed_reports(df, "DONE")) == [1]
    assert ids(listed_reports(df, None)) == [1, 2]
    assert ids(listed_reports(df, "DONE", [{"k": "status", "v": "EXPIRED", "o": "eq"}])) == [2]


def test_rollup_treats_absent_keys_as_null_and_missing_data_as_zero(spark):
    base = {"data_source_id": "ds", "job_id": "j", "job_task_id": "t", "billed_month": "2024-01", "billed_year": "2024"}
    keys = ["usage_unit", "provider", "region_code", "region_key", "product", "usage_type", "resource", "service_account_id", "project_id", "workspace_id"]
    df = spark.sql(
        """select * from values (map('a','1'), 1.0, map('d', 5.0)), (map('a','1','b',null), 2.0, null), (map('b','2'), 4.0, map())
           as t(tags, cost, data)"""
    ).withColumns({**{k: F.lit(v) for k, v in base.items()}, **{k: F.lit(None).cast("string") for k in keys}, "usage_quantity": F.lit(1.0)})
    rolled = monthly_rollup(df, data_keys=["d"])
    assert rows(rolled.selectExpr("tags['a']", "tags['b']", "cast(cost as double)", "cast(data['d'] as double)", "usage_quantity")) == [
        ("1", None, 3.0, 5.0, 2.0), (None, "2", 4.0, 0.0, 1.0)
    ]
    assert rows(rolled.selectExpr("map_keys(tags)", "data['d'] > 0")) == [(["a"], True), (["b"], False)]


def test_analyze_rejects_other_aggregates(spark):
    with pytest.raises(ValueError):
        analyze(spark.range(1), {"x": {"key": "id", "operator": "max"}})


def test_month_calendar(spark):
    months = spark.createDataFrame([("2024-01",), ("2024-02",)], "billed_month string")
    out = month_calendar(months, F.lit("2024-02-15"), {"aggregation_day": 15, "exchange_day": 31})
    assert rows(out.selectExpr("billed_month", "is_confirmed", "string(aggregation_date)", "string(exchange_date)")) == [
        ("2024-01", True, "2024-01-15", "2024-01-31"), ("2024-02", False, "2024-02-15", "2024-02-15")
    ]


def test_unify_folds_and_drops(spark):
    empty = {key: F.lit(None).cast("string") for key in UNIFIED_KEYS}
    rows_in = [("w1", "s"), ("v-1", "s"), ("v-9", "s"), (None, "s"), ("off", "s"), ("w1", "own"), ("w2", "own"), ("w1", "gone")]
    monthly = spark.createDataFrame(rows_in, "workspace_id string, data_source_id string")
    monthly = monthly.withColumns(
        {**{k: v for k, v in empty.items() if k not in monthly.columns}, "cost": F.lit(1).cast("decimal(20,4)"), "usage_quantity": F.lit(1.0)}
    )
    known = spark.createDataFrame([("x", "w1", "v-1"), ("y", None, "v-9")], "account_id string, workspace_id string, v_workspace_id string")
    workspaces = spark.createDataFrame([("w1", "ENABLED"), ("w2", "ENABLED"), ("off", "DISABLED")], "workspace_id string, state string")
    sources = spark.createDataFrame([("s", "*"), ("own", "w2")], "data_source_id string, workspace_id string")
    out = unify(monthly, known, workspaces, sources)
    assert rows(out.selectExpr("workspace_id", "data_source_id", "cast(cost as int)")) == [("w1", "s", 2), ("w2", "own", 1), (None, "s", 1)]


def test_warehouse_tables(spark):
    spark.range(3).selectExpr("'p' as product", "'2024-01-01' as billed_date", "id as cost").createOrReplaceTempView("wh_daily")
    places = {"DATABRICKS": {"aws": {"catalog": "", "schema": "", "table": {"DAILY": "wh_daily"}}}}
    source = {"data_source_type": "WAREHOUSE", "provider": "aws", "warehouse_info": {"type": "DATABRICKS"}}
    out = warehouse.analyze_source(spark, source, "DAILY", {}, places, fields={"cost": {"key": "cost"}}, group_by=["product"])
    assert rows(out) == [("p", "2024-01-01", 3)]
    local = {"DAILY": spark.table("wh_daily"), "MONTHLY": None}
    assert warehouse.cost_table(spark, {"data_source_type": "EXTERNAL"}, "DAILY", local, {}) is local["DAILY"]
    with pytest.raises(ValueError):
        warehouse.table_name({**source, "warehouse_info": {"type": "OTHER"}}, places, "DAILY")
