"""Classification rules."""

from pyspark.sql import functions as F

from spendframe.operators import rule_table, rules
from spendframe.plans.registry import query
from spendframe.sources import sample

_IDS = ["cost_id", "data_source_id", "workspace_id", "project_id", "service_account_id"]


def _rule(order, actions, conditions=(), policy="ALL", rule_type="CUSTOM", stop=False, source=None):
    return {
        "order": order,
        "rule_type": rule_type,
        "data_source_id": source,
        "conditions_policy": policy,
        "conditions": [{"key": key, "operator": operator, "value": value} for key, operator, value in conditions],
        "actions": actions,
        "options": {"stop_processing": stop},
    }


def _dims(spark, sf_dir):
    return {
        "workspaces": sample.workspaces(spark, sf_dir),
        "projects": sample.projects(spark, sf_dir),
        "service_accounts": sample.service_accounts(spark, sf_dir),
    }


@query(
    "rule_conditions",
    """
SELECT cost_id, coalesce(tag_status = 'O', false) AS is_eq, coalesce(contains(lower(tag_status), 'f'), false) AS is_contain,
       coalesce(tag_status <> 'O', false) AS is_not, coalesce(NOT contains(lower(tag_status), 'f'), false) AS is_not_contain
FROM cost
""",
    ("cost",),
)
def rule_conditions(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "cost_id", "tags")
    tests = {"eq": "O", "contain": "F", "not": "O", "not_contain": "F"}
    held = [
        rules.condition_holds({"key": "tags.status", "operator": operator, "value": value}).alias(f"is_{operator}")
        for operator, value in tests.items()
    ]
    return rows.select("cost_id", *held)


_POLICY_CONDITIONS = [("provider", "eq", "asia"), ("product", "contain", "brand#1"), ("tags.status", "not", "O")]


@query(
    "rule_policy",
    """
SELECT cost_id, true AS is_always,
       provider = 'asia' AND contains(lower(product), 'brand#1') AND coalesce(tag_status <> 'O', false) AS is_all,
       provider = 'asia' OR contains(lower(product), 'brand#1') OR coalesce(tag_status <> 'O', false) AS is_any
FROM cost
""",
    ("cost",),
)
def rule_policy(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "cost_id", "provider", "product", "tags")
    held = [
        rules.policy_holds(_rule(1, {}, _POLICY_CONDITIONS, policy)).alias(f"is_{policy.lower()}")
        for policy in ("ALWAYS", "ALL", "ANY")
    ]
    return rows.select("cost_id", *held)


@query(
    "rule_order_stop",
    """
SELECT cost_id, CASE
    WHEN provider = 'asia' AND contains(lower(product), 'brand#1') THEN 'project-second'
    WHEN provider = 'europe' THEN 'project-fourth'
    WHEN provider <> 'asia' AND contains(lower(usage_type), 'small') THEN 'project-third'
    WHEN provider = 'asia' AND contains(lower(usage_type), 'small') THEN 'project-third'
    WHEN provider = 'asia' THEN 'project-first'
    ELSE project_id END AS project_id
FROM cost
""",
    ("cost",),
)
def rule_order_stop(spark, sf_dir):
    ordered = [
        _rule(4, {"change_project": "project-fourth"}, [("provider", "eq", "europe")]),
        _rule(2, {"change_project": "project-second"}, [("provider", "eq", "asia"), ("product", "contain", "Brand#1")], stop=True),
        _rule(1, {"change_project": "project-first"}, [("provider", "eq", "asia")]),
        _rule(3, {"change_project": "project-third"}, [("usage_type", "contain", "SMALL")]),
    ]
    rows = sample.cost(spark, sf_dir, *_IDS, "provider", "product", "usage_type")
    return rules.apply_rules(rows, ordered).select("cost_id", "project_id")


@query(
    "rule_two_phase",
    """
SELECT cost_id, CASE WHEN usage_unit = 'GB' THEN 'project-custom'
    WHEN provider = 'asia' THEN 'project-managed'
    WHEN data_source_id = 'ds-1' THEN 'project-managed-2'
    ELSE project_id END AS project_id
FROM cost
""",
    ("cost",),
)
def rule_two_phase(spark, sf_dir):
    # A stop in the managed phase does not hold back the custom phase.
    both = [
        _rule(1, {"change_project": "project-custom"}, [("usage_unit", "eq", "GB")]),
        _rule(1, {"change_project": "project-managed"}, [("provider", "eq", "asia")], rule_type="MANAGED", stop=True),
        _rule(2, {"change_project": "project-managed-2"}, (), "ALWAYS", rule_type="MANAGED", source="ds-1"),
    ]
    rows = sample.cost(spark, sf_dir, *_IDS, "provider", "usage_unit")
    return rules.apply_rules(rows, both).select("cost_id", "project_id")


@query(
    "rule_change_project",
    """
SELECT cost_id, CASE WHEN product = 'Brand#3' OR product = 'Brand#4' THEN 'project-brand' ELSE project_id END AS project_id FROM cost
""",
    ("cost",),
)
def rule_change_project(spark, sf_dir):
    either = [_rule(1, {"change_project": "project-brand"}, [("product", "eq", "Brand#3"), ("product", "eq", "Brand#4")], "ANY")]
    rows = sample.cost(spark, sf_dir, *_IDS, "product")
    return rules.apply_rules(rows, either).select("cost_id", "project_id")


@query(
    "rule_match_workspace",
    """
SELECT c.cost_id, coalesce(w.workspace_id, c.workspace_id) AS workspace_id
FROM cost c LEFT JOIN workspace w ON c.provider = 'asia' AND w.name = 'Workspace ' || CASE c.usage_unit WHEN 'GB' THEN 'BUILDING' WHEN 'Hrs' THEN 'MACHINERY' ELSE 'NONE' END
""",
    ("cost", "workspace"),
)
def rule_match_workspace(spark, sf_dir):
    match = [_rule(1, {"match_workspace": {"source": "label", "target": "name"}}, [("provider", "eq", "asia")])]
    team = F.when(F.col("usage_unit") == "GB", "BUILDING").when(F.col("usage_unit") == "Hrs", "MACHINERY")
    rows = sample.cost(spark, sf_dir, *_IDS, "provider", "usage_unit").withColumn(
        "label", F.concat(F.lit("Workspace "), team.otherwise("NONE"))
    )
    return rules.apply_rules(rows, match, _dims(spark, sf_dir)).select("cost_id", "workspace_id")


@query(
    "rule_match_project",
    """
SELECT c.cost_id, coalesce(p.project_id, c.project_id) AS project_id,
       coalesce(c.workspace_id, p.workspace_id) AS workspace_id
FROM cost c
LEFT JOIN (SELECT w.workspace_id AS scope, p.k, min(p.project_id) AS project_id, min_by(p.workspace_id, p.project_id) AS workspace_id
           FROM project p JOIN (SELECT DISTINCT workspace_id FROM project UNION ALL SELECT NULL) w
             ON w.workspace_id IS NULL OR w.workspace_id = p.workspace_id GROUP BY ALL) p
  ON p.scope IS NOT DISTINCT FROM c.workspace_id AND CAST(p.k AS varchar) = substr(c.data_source_id, 4)
""",
    ("cost", "project"),
)
def rule_match_project(spark, sf_dir):
    match = [_rule(1, {"match_project": {"source": "number", "target": "k"}}, (), "ALWAYS")]
    rows = sample.cost(spark, sf_dir, *_IDS).withColumn("number", F.substring("data_source_id", 4, 10))
    return rules.apply_rules(rows, match, _dims(spark, sf_dir)).select("cost_id", "project_id", "workspace_id")


@query(
    "rule_match_service_account",
    """
SELECT cost_id,
       coalesce(service_account_found, own) AS service_account_id,
       CASE WHEN service_account_found IS NOT NULL THEN project_found ELSE project_id END AS project_id,
       CASE WHEN service_account_found IS NULL THEN workspace_id
            WHEN data_source_id = 'ds-1' THEN workspace_found
            ELSE coalesce(workspace_id, workspace_found) END AS workspace_id
FROM (
  SELECT c.cost_id, c.data_source_id, c.service_account_id AS own, c.project_id, c.workspace_id,
         s.service_account_id AS service_account_found, s.project_id AS project_found, s.workspace_id AS workspace_found
  FROM cost c
  LEFT JOIN service_account s ON s.service_account_id = c.service_account_id
   AND (c.data_source_id = 'ds-1' OR c.workspace_id IS NULL OR s.workspace_id = c.workspace_id))
""",
    ("cost", "service_account"),
)
def rule_match_service_account(spark, sf_dir):
    source = "service_account_id"
    match = [
        _rule(1, {"match_service_account": {"source": source, "all_workspaces": True}}, (), "ALWAYS", source="ds-1"),
        _rule(2, {"match_service_account": {"source": "original"}}, (), "ALWAYS", source="ds-0"),
        _rule(3, {"match_service_account": {"source": "original"}}, (), "ALWAYS", source="ds-2"),
    ]
    rows = sample.cost(spark, sf_dir, *_IDS).withColumn("original", F.col(source))
    return rules.apply_rules(rows, match, _dims(spark, sf_dir)).select(
        "cost_id", "service_account_id", "project_id", "workspace_id"
    )


@query(
    "rule_add_info",
    """
SELECT cost_id,
       CASE WHEN contains(lower(product), 'brand#2') THEN 'small-team' ELSE info_size END AS size,
       CASE WHEN provider = 'asia' THEN 'east' END AS zone,
       CASE WHEN provider = 'asia' THEN 'project-east' ELSE project_id END AS project_id
FROM cost
""",
    ("cost",),
)
def rule_add_info(spark, sf_dir):
    adding = [
        _rule(1, {"add_additional_info": {"zone": "east"}}, [("provider", "eq", "asia")]),
        _rule(2, {"add_additional_info": {"size": "big-team"}}, [("product", "contain", "brand#2")]),
        # Reads what rule 1 wrote, so it runs in a second stage.
        _rule(3, {"change_project": "project-east"}, [("additional_info.zone", "eq", "east")]),
        _rule(4, {"add_additional_info": {"size": "small-team"}}, [("product", "contain", "brand#2")]),
    ]
    rows = sample.cost(spark, sf_dir, *_IDS, "provider", "product", "additional_info")
    info = F.col("additional_info")
    return rules.apply_rules(rows, adding).select(
        "cost_id", info["size"].alias("size"), info["zone"].alias("zone"), "project_id"
    )


@query(
    "rule_table",
    """
SELECT cost_id,
       CASE WHEN contains(lower(usage_type), 'small') THEN 'project-small'
            WHEN provider <> 'asia' AND 'ds-' || (CAST(substr(product, 7) AS int) % 3) = data_source_id THEN 'project-' || product
            ELSE project_id END AS project_id,
       CASE WHEN NOT contains(lower(usage_type), 'small') AND provider <> 'asia'
             AND 'ds-' || (CAST(substr(product, 7) AS int) % 3) = data_source_id THEN product ELSE info_size END AS size
FROM cost
""",
    ("cost",),
)
def rule_table_(spark, sf_dir):
    """A rule for each brand, of one source each, and one for all sources that stops the others; all from a table."""
    number = F.substring("p_brand", 7, 9).cast("int")
    brands = sample.table(spark, sf_dir, "part").select("p_brand", number.alias("n")).distinct()
    none = F.lit(None).cast("string")

    def condition(key, operator, value):
        return F.struct(F.lit(key).alias("key"), F.lit(operator).alias("operator"), value.alias("value"))

    def action(kind, value=none, info=F.lit(None)):
        names = {"kind": F.lit(kind), "source": none, "target": none, "anywhere": F.lit(None).cast("boolean"), "value": value, "info": info.cast(rule_table.INFO)}
        return F.struct(*[column.alias(name) for name, column in names.items()])

    size = F.array(F.struct(F.lit("size").alias("key"), F.col("p_brand").alias("value")))
    own = brands.select(
        F.concat(F.lit("rule-"), "p_brand").alias("rule_id"),
        F.concat(F.lit("ds-"), (F.col("n") % 3).cast("string")).alias("data_source_id"),
        F.lit("CUSTOM").alias("rule_type"),
        F.col("n").alias("order"),
        F.lit("ALL").alias("conditions_policy"),
        F.array(condition("product", "eq", F.col("p_brand")), condition("provider", "not", F.lit("asia"))).alias("conditions"),
        F.array(action("change_project", F.concat(F.lit("project-"), "p_brand")), action("add_additional_info", info=size)).alias("actions"),
        F.lit(False).alias("stop_processing"),
    )
    everywhere = brands.agg(F.min("n").alias("n")).select(
        F.lit("rule-small").alias("rule_id"),
        none.alias("data_source_id"),
        F.lit("CUSTOM").alias("rule_type"),
        (F.col("n") - 1).alias("order"),
        F.lit("ANY").alias("conditions_policy"),
        F.array(condition("usage_type", "contain", F.lit("SMALL"))).alias("conditions"),
        F.array(action("change_project", F.lit("project-small"))).alias("actions"),
        F.lit(True).alias("stop_processing"),
    )
    rows = sample.cost(spark, sf_dir, *_IDS, "provider", "product", "usage_type", "additional_info")
    classified = rule_table.apply_rule_table(rows, own.unionByName(everywhere))
    return classified.select("cost_id", "project_id", F.col("additional_info")["size"].alias("size"))


_RULE_KEYS = "CASE p_size % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'tags.team' WHEN 2 THEN 'cost' WHEN 3 THEN 'provider' ELSE '' END"
_RULE_OPERATORS = "CASE p_size % 3 WHEN 0 THEN 'eq' WHEN 1 THEN 'contain' ELSE 'like' END"


@query(
    "rule_validate",
    f"""
SELECT rule_id, CASE WHEN key = '' THEN 'incomplete condition' WHEN key = 'cost' THEN 'unsupported key' ELSE 'unsupported operator' END AS reason
FROM (SELECT 'rule-' || p_partkey AS rule_id, {_RULE_KEYS} AS key, {_RULE_OPERATORS} AS operator FROM part)
WHERE key IN ('', 'cost') OR operator = 'like'
""",
)
def rule_validate(spark, sf_dir):
    parts = sample.table(spark, sf_dir, "part")
    condition = F.struct(
        F.expr(_RULE_KEYS).alias("key"), F.expr(_RULE_OPERATORS).alias("operator"), F.col("p_brand").alias("value")
    )
    fine = F.struct(F.lit("provider").alias("key"), F.lit("eq").alias("operator"), F.lit("asia").alias("value"))
    proposed = parts.select(
        F.concat(F.lit("rule-"), F.col("p_partkey").cast("string")).alias("rule_id"),
        F.array(fine, condition).alias("conditions"),
    )
    return rules.invalid_conditions(proposed).select("rule_id", "reason")


@query(
    "rule_resequence",
    """
WITH rule AS (
  SELECT p_type AS data_source_id, 'rule-' || lpad(CAST(p_partkey AS varchar), 12, '0') AS rule_id, p_size AS "order" FROM part),
move AS (SELECT data_source_id, max(rule_id) AS moved_id, 3 AS new_order FROM rule GROUP BY ALL HAVING max("order") >= 3),
ranked AS (
  SELECT r.data_source_id, r.rule_id, m.new_order,
         row_number() OVER (PARTITION BY r.data_source_id ORDER BY r."order", r.rule_id) AS place
  FROM rule r LEFT JOIN move m USING (data_source_id) WHERE m.moved_id IS NULL OR r.rule_id <> m.moved_id)
SELECT data_source_id, rule_id, CAST(CASE WHEN place >= new_order THEN place + 1 ELSE place END AS integer) AS "order" FROM ranked
UNION ALL SELECT data_source_id, moved_id, new_order FROM move
""",
)
def rule_resequence(spark, sf_dir):
    rule_id = F.concat(F.lit("rule-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    existing = sample.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("data_source_id"), rule_id.alias("rule_id"), F.col("p_size").alias("order")
    )
    moves = existing.groupBy("data_source_id").agg(F.max("rule_id").alias("moved_id"), F.lit(3).alias("new_order"))
    return rules.resequence(existing, moves, ("data_source_id",), "rule_id")


@query(
    "rule_refused_moves",
    """
SELECT p_type AS data_source_id, 'rule-' || lpad(CAST(max(p_partkey) AS varchar), 12, '0') AS moved_id, 49 AS new_order, max(p_size) AS highest_order
FROM part GROUP BY ALL HAVING max(p_size) < 49
""",
)
def rule_refused_moves(spark, sf_dir):
    rule_id = F.concat(F.lit("rule-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    existing = sample.table(spark, sf_dir, "part").select(F.col("p_type").alias("data_source_id"), rule_id.alias("rule_id"), F.col("p_size").alias("order"))
    moves = existing.groupBy("data_source_id").agg(F.max("rule_id").alias("moved_id"), F.lit(49).alias("new_order"))
    return rules.refused_moves(existing, moves, ("data_source_id",))
