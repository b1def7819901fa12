"""Rules from a table give what rules from a list give, whatever their number."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spendframe.operators.rule_table import RULE_TABLE, apply_rule_table, rule_rows
from spendframe.operators.rules import apply_rules

LINES = "id int, data_source_id string, workspace_id string, project_id string, service_account_id string, provider string, product string, tags map<string,string>, additional_info map<string,string>"


@pytest.fixture(scope="module")
def dims(spark):
    draw = random.Random(1)
    accounts = [(f"sa{i}", draw.choice(["w0", "w1", None]), draw.choice(["p0", "p1", None]), f"n{i % 4}") for i in range(9)]
    projects = [(f"p{i}", draw.choice(["w0", "w1"]), f"n{i % 3}") for i in range(7)]
    return {
        "workspaces": spark.createDataFrame([("w1", "n0"), ("w0", "n0"), ("w2", "n1"), ("w3", None)], "workspace_id string, name string"),
        "projects": spark.createDataFrame(projects, "project_id string, workspace_id string, name string"),
        "service_accounts": spark.createDataFrame(accounts, "service_account_id string, workspace_id string, project_id string, name string"),
    }


def table(spark, rules):
    return spark.createDataFrame(rule_rows(rules), RULE_TABLE)


def lines(spark, draw, count):
    def some(*values):
        return draw.choice([*values, None])

    made = [
        (i, draw.choice(["s0", "s1", "s2"]), some("w0", "w1"), some("p0", "p1"), some("sa1"), some("aws", "azure", "AWS gov"), some("n0", "n1", "n2"),
         some({"team": "n0"}, {"team": "Blue", "env": "x"}), some({}, {"zone": "n1"}))
        for i in range(count)
    ]
    return spark.createDataFrame(made, LINES)


def drawn_rules(draw, count, sources=("s0", "s1", None)):
    def condition():
        return {"key": draw.choice(["provider", "product", "tags.team", "additional_info.zone"]), "operator": draw.choice(["eq", "contain", "not", "not_contain"]), "value": draw.choice(["aws", "N0", "n1", "blue"])}

    def action():
        source = draw.choice(["product", "tags.team", "additional_info.zone", "project_id", "service_account_id"])
        match = {"source": source, "target": "name", "all_workspaces": draw.random() < 0.5}
        name = draw.choice(["change_project", "match_workspace", "match_project", "match_service_account", "add_additional_info"])
        return name, {"change_project": draw.choice(["n0", "n1", "px"]), "add_additional_info": {draw.choice(["zone", "team"]): draw.choice(["n0", "n2"])}}.get(name, match)

    return [
        {
            "order": i,
            "rule_type": draw.choice(["MANAGED", "CUSTOM"]),
            "data_source_id": draw.choice(sources),
            "conditions_policy": draw.choice(["ALWAYS", "ALL", "ANY"]),
            "conditions": [condition() for _ in range(draw.randrange(3))],
            "actions": dict(action() for _ in range(draw.choice([1, 1, 2, 3]))),
            "options": {"stop_processing": draw.random() < 0.2},
        }
        for i in range(count)
    ]


def shown(df):
    """Rows with their info; a list of rules turns null info into an empty map where it might have added some."""
    info = F.array_sort(F.map_entries(F.coalesce("additional_info", F.create_map().cast("map<string,string>"))))
    return rows(df.select("id", "workspace_id", "project_id", "service_account_id", F.to_json(F.map_from_entries(info))))


@pytest.mark.parametrize("seed", range(6))
def test_a_table_does_what_a_list_does(spark, dims, seed):
    draw = random.Random(seed)
    df, rules = lines(spark, draw, 60), drawn_rules(draw, 7)
    assert shown(apply_rule_table(df, table(spark, rules), dims)) == shown(apply_rules(df, rules, dims))


def test_plan_does_not_grow_with_the_rules(spark):
    """1,000 rules of 100 sources, among them rules for all sources."""
    df = spark.range(5000).selectExpr("int(id) id", "concat('s', id % 120) data_source_id", "'w' workspace_id", "'old' project_id", "concat('k', id % 50) product")

    def made(count):
        return [
            {"order": i, "rule_type": "CUSTOM", "data_source_id": f"s{i % 100}" if i % 50 else None, "conditions_policy": "ALL",
             "conditions": [{"key": "product", "operator": "eq", "value": f"k{i % 47}"}], "actions": {"change_project": f"p{i}"}}
            for i in range(count)
        ]

    few, many = (apply_rule_table(df, table(spark, made(count))) for count in (100, 1000))
    sizes = [len(out._jdf.queryExecution().optimizedPlan().toString()) for out in (few, many)]
    assert abs(sizes[1] - sizes[0]) < 200
    expected = {}
    for rule in made(1000):
        expected.setdefault(rule["conditions"][0]["value"], []).append((rule["data_source_id"], rule["actions"]["change_project"]))
    for row in many.select("id", "project_id").collect():
        hits = [project for source, project in expected.get(f"k{row.id % 50}", []) if source in (None, f"s{row.id % 120}")]
        assert row.project_id == (hits[-1] if hits else "old")


def test_no_rules_and_no_rows(spark, dims):
    draw = random.Random(3)
    df = lines(spark, draw, 10)
    empty = spark.createDataFrame([], RULE_TABLE)
    assert shown(apply_rule_table(df, empty, dims)) == shown(df)
    assert apply_rule_table(df.where("false"), table(spark, drawn_rules(draw, 4)), dims).count() == 0


def test_lookups_may_follow_each_other(spark, dims):
    """What is found by one rule is looked up by the next, three deep."""
    df = spark.createDataFrame([(1, "s", None, "n1"), (2, "s", None, "zz"), (3, "t", "w0", "n1")], "id int, data_source_id string, workspace_id string, project_id string")
    match = {"source": "project_id", "all_workspaces": True}
    rules = [
        {"order": 1, "rule_type": "CUSTOM", "data_source_id": "s", "actions": {"match_project": {**match, "target": "name"}}},
        {"order": 2, "rule_type": "CUSTOM", "actions": {"match_project": {**match, "target": "project_id"}, "change_project": "n2"}},
        {"order": 3, "rule_type": "CUSTOM", "actions": {"match_project": {**match, "target": "name"}}},
    ]
    out = apply_rule_table(df, table(spark, rules), dims)
    assert rows(out) == rows(apply_rules(df, rules, dims))
