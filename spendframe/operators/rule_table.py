"""Classification by a table of rules: however many rules there are, none enters the plan.

`rules.apply_rules` compiles a short list of rules into columns. Here the rules of each data source travel as one sorted
array that is joined to the lines by source, and a fold runs through it in order: it tests a rule's conditions on the values
as they then are, acts, and remembers which phase has been stopped. The size of the plan depends on the columns and targets that rules name.

Lookups of a value in workspaces, projects or service accounts are joins, made before the fold for the values that lines have
at first. A rule may look up what an earlier rule wrote; the fold then leaves the line with a question, which is
answered by a further join, and the line is folded again. Only lines with questions go round, and only where such rules exist.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.paths import path
from spendframe.functions.predicates import definitely
from spendframe.operators.lookups import first_by, lookup
from spendframe.operators.rules import LOOKUP_ACTIONS, PHASES, in_order, lookup_table
from spendframe.schema import LAST_ORDER
from spendframe.session import durable

CONDITION = "struct<key:string,operator:string,value:string>"
INFO = "array<struct<key:string,value:string>>"
ACTION = f"struct<kind:string,source:string,target:string,anywhere:boolean,value:string,info:{INFO}>"
#: A rule table has one row for each rule; actions run in the order of the array.
RULE_TABLE = f"rule_id string, data_source_id string, rule_type string, `order` int, conditions_policy string, conditions array<{CONDITION}>, actions array<{ACTION}>, stop_processing boolean"

_FOUND = "struct<workspace_id:string,project_id:string,service_account_id:string>"
_QUESTION = "struct<kind:string,target:string,scope:string,value:string>"
_STATE = f"struct<workspace_id:string,project_id:string,service_account_id:string,info:map<string,string>,stopped:array<string>,question:{_QUESTION}>"
_ANSWERS = f"array<struct<question:{_QUESTION},found:{_FOUND}>>"


def rule_rows(rules: list[dict]) -> list[tuple]:
    """Rows of a rule table for rules given as dicts, as `rules.apply_rules` takes them."""
    return [_row(f"{place:06}", rule) for place, rule in enumerate(in_order(rules))]


def _row(rule_id: str, rule: dict) -> tuple:
    actions = []
    for name, spec in rule["actions"].items():
        if not spec:
            continue
        if name in LOOKUP_ACTIONS:
            anywhere = name == "match_workspace" or bool(spec.get("all_workspaces", False))
            actions.append((name, spec["source"], spec.get("target", LOOKUP_ACTIONS[name][1]), anywhere, None, None))
        elif name == "add_additional_info":
            actions.append((name, None, None, None, None, list(spec.items())))
        else:
            actions.append((name, None, None, None, spec, None))
    conditions = [(spec["key"], spec["operator"], spec["value"]) for spec in rule.get("conditions") or []]
    stop = bool((rule.get("options") or {}).get("stop_processing"))
    return (rule_id, rule.get("data_source_id"), rule["rule_type"], rule.get("order"), rule.get("conditions_policy", "ALWAYS"), conditions, actions, stop)


def rules_by_source(rules: DataFrame) -> DataFrame:
    """(data_source_id, rules, specs): each source's rules in order, rules of all sources included, and its distinct lookups.

    The row with a null source has the rules of all sources; it serves sources without rules of their own.
    """
    phase = F.array_position(F.array(*[F.lit(name) for name in PHASES]), F.col("rule_type"))
    one = F.struct(
        phase.alias("phase"), F.coalesce("order", F.lit(LAST_ORDER)).alias("order"), "rule_id", "rule_type", "conditions_policy", "conditions", "actions", "stop_processing"
    )
    # The rules of one source: a page or two of settings.
    own = rules.groupBy("data_source_id").agg(F.collect_list(one).alias("rules"))
    everywhere = rules.where("data_source_id is null").agg(F.collect_list(one).alias("rules"))
    sources = own.where("data_source_id is not null").select("data_source_id", F.concat("rules", everywhere.scalar()).alias("rules"))
    listed = sources.unionByName(everywhere.withColumn("data_source_id", F.lit(None).cast("string")))
    lookups = F.filter(F.flatten(F.transform("rules", lambda rule: rule["actions"])), lambda action: action["kind"].isin(list(LOOKUP_ACTIONS)))
    specs = F.array_distinct(F.transform(lookups, lambda a: F.struct(a["kind"].alias("kind"), a["source"].alias("source"), a["target"].alias("target"), a["anywhere"].alias("anywhere"))))
    return listed.select("data_source_id", F.array_sort("rules").alias("rules"), specs.alias("specs"))


def _targets(by_source: DataFrame) -> list[tuple[str, str]]:
    found = by_source.select(F.explode("specs").alias("spec")).select("spec.kind", "spec.target").distinct()
    return sorted((row.kind, row.target) for row in found.collect())


def _answers(targets: list[tuple[str, str]], dims: dict[str, DataFrame]) -> DataFrame | None:
    """(kind, target, _scope, _value, _found) for all that may be looked up. One branch for each named target column."""
    tables = []
    for kind, target in targets:
        dim, id_column = dims[LOOKUP_ACTIONS[kind][0]], LOOKUP_ACTIONS[kind][1]
        held = [F.col(name) if name in dim.columns and (name != "project_id" or kind != "match_workspace") else F.lit(None).cast("string").alias(name) for name in ("workspace_id", "project_id", "service_account_id")]
        if kind == "match_workspace":
            named = dim.where(path(target).isNotNull()).select(path(target).cast("string").alias("_value"), F.struct(*held).cast(_FOUND).alias("_found"), id_column)
            table = first_by(named, ["_value"], id_column, ["_found"]).withColumn("_scope", F.lit(None).cast("string"))
        else:
            table = lookup_table(dim, id_column, target, held).withColumn("_found", F.col("_found").cast(_FOUND))
        tables.append(table.select(F.lit(kind).alias("_kind"), F.lit(target).alias("_target"), "_scope", "_value", "_found"))
    if not tables:
        return None
    first, *others = tables
    for table in others:
        first = first.unionByName(table)
    return first


def _value(state: Column, key: Column, known: Column, tags: Column) -> Column:
    """A field of the line as it now stands."""
    written = F.when(key == "workspace_id", state["workspace_id"]).when(key == "project_id", state["project_id"]).when(key == "service_account_id", state["service_account_id"])
    info = F.try_element_at(state["info"], F.substring(key, 17, 1 << 20))
    tag = F.try_element_at(tags, F.substring(key, 6, 1 << 20))
    return written.when(F.startswith(key, F.lit("additional_info.")), info).when(F.startswith(key, F.lit("tags.")), tag).otherwise(F.try_element_at(known, key))


def _holds(state: Column, rule: Column, known: Column, tags: Column) -> Column:
    def test(spec: Column) -> Column:
        value = _value(state, spec["key"], known, tags)
        inside = F.contains(F.lower(value), F.lower(spec["value"]))
        hit = F.when(spec["operator"] == "eq", value == spec["value"]).when(spec["operator"] == "not", value != spec["value"])
        return definitely(hit.when(spec["operator"] == "contain", inside).when(spec["operator"] == "not_contain", ~inside))

    conditions = F.coalesce(rule["conditions"], F.array().cast(f"array<{CONDITION}>"))
    policy = rule["conditions_policy"]
    return (policy == "ALWAYS") | ((policy == "ALL") & F.forall(conditions, test)) | ((policy == "ANY") & F.exists(conditions, test))


def _act(state: Column, action: Column, known: Column, tags: Column, scope: Column, answers: Column) -> Column:
    """The state after one action, or with a question if it looks up a value that has not been asked for yet."""
    kind = action["kind"]
    value = _value(state, action["source"], known, tags)
    limit = F.when(~action["anywhere"], scope)
    asked = F.filter(
        answers,
        lambda answer: (answer["question"]["kind"] == kind)
        & (answer["question"]["target"] == action["target"])
        & answer["question"]["scope"].eqNullSafe(limit)
        & (answer["question"]["value"] == value),
    )
    looks = kind.isin(list(LOOKUP_ACTIONS)) & value.isNotNull()
    found = F.try_element_at(asked, F.lit(1))["found"]
    hit = looks & found.isNotNull()
    workspace = (
        F.when(hit & ((kind == "match_workspace") | ((kind == "match_service_account") & action["anywhere"])), found["workspace_id"])
        .when(hit, F.coalesce(state["workspace_id"], found["workspace_id"]))
        .otherwise(state["workspace_id"])
    )
    project = F.when(kind == "change_project", action["value"]).when(hit & (kind != "match_workspace"), found["project_id"]).otherwise(state["project_id"])
    account = F.when(hit & (kind == "match_service_account"), found["service_account_id"]).otherwise(state["service_account_id"])
    added = F.map_from_entries(action["info"])
    old = F.map_filter(state["info"], lambda key, _: ~F.array_contains(F.map_keys(added), key))
    info = F.when(kind == "add_additional_info", F.coalesce(F.map_concat(old, added), added)).otherwise(state["info"])
    question = F.when(looks & (F.size(asked) == 0), F.struct(kind.alias("kind"), action["target"].alias("target"), limit.alias("scope"), value.alias("value")))
    after = F.struct(
        workspace.alias("workspace_id"), project.alias("project_id"), account.alias("service_account_id"), info.alias("info"), state["stopped"].alias("stopped"), question.alias("question")
    )
    return F.when(state["question"].isNull(), after.cast(_STATE)).otherwise(state)


def _fold(rules: Column, start: Column, known: Column, tags: Column, scope: Column, answers: Column) -> Column:
    def run(state: Column, rule: Column) -> Column:
        open_ = state["question"].isNull() & ~F.array_contains(state["stopped"], rule["rule_type"])
        acted = F.aggregate(rule["actions"], state, lambda now, action: _act(now, action, known, tags, scope, answers))
        stop = F.when(rule["stop_processing"], F.array(rule["rule_type"])).otherwise(F.array().cast("array<string>"))
        stopped = F.concat(acted["stopped"], stop)
        names = ("workspace_id", "project_id", "service_account_id", "info")
        after = F.struct(*[acted[name].alias(name) for name in names], stopped.alias("stopped"), acted["question"].alias("question"))
        return F.when(open_ & _holds(state, rule, known, tags), after.cast(_STATE)).otherwise(state)

    return F.aggregate(rules, start, run)


def apply_rule_table(df: DataFrame, rules: DataFrame, dims: dict[str, DataFrame] | None = None, scope: str = "real_workspace_id") -> DataFrame:
    """Classify every row by the rules of its data source, as `rules.apply_rules` does with a list of them.

    `rules` is a RULE_TABLE. A null order comes last, equal orders run by rule id, and a null data source means all sources.
    Conditions and sources name columns, `tags.k` or `additional_info.k`; names that the rows do not have are null. Rows of
    sources without rules stay as they are.
    """
    by_source = durable(rules_by_source(rules), "rules")
    targets = _targets(by_source)
    named = by_source.select(F.explode("rules").alias("rule"))
    keys = named.select(F.explode("rule.conditions.key").alias("key")).union(by_source.select(F.explode("specs.source"))).distinct()
    simple = sorted({row.key for row in keys.collect()} & set(df.columns))
    width = by_source.agg(F.max(F.size("specs"))).first()[0] or 0  # lookups that one source makes, a few

    limit = F.col(scope) if scope in df.columns else F.col("workspace_id")
    bags = {name: F.col(name) if name in df.columns else F.lit(None).cast("map<string,string>") for name in ("tags", "additional_info")}
    entries = [part for name in simple for part in (F.lit(name), F.col(name).cast("string"))]
    known = F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")
    none = F.lit(None).cast("string")
    own = {name: F.col(name) if name in df.columns else none for name in ("workspace_id", "project_id", "service_account_id")}
    start = F.struct(*[value.alias(name) for name, value in own.items()], bags["additional_info"].alias("info"), F.array().cast("array<string>").alias("stopped"), F.lit(None).cast(_QUESTION).alias("question"))

    everywhere = by_source.where("data_source_id is null").select(F.struct("rules", "specs")).scalar()
    listed = by_source.where("data_source_id is not null").select("data_source_id", F.struct("rules", "specs").alias("_rules"))
    rows = lookup(df.withColumns({"_start": start.cast(_STATE), "_known": known, "_tags": bags["tags"], "_limit": limit}), listed, ["data_source_id"])
    rows = rows.withColumn("_rules", F.coalesce("_rules", everywhere)).withColumns({"_specs": F.col("_rules.specs"), "_rules": F.col("_rules.rules")})
    answers = _answers(targets, dims or {})
    if answers is not None:
        answers = durable(answers, "rule-lookups")
    slots = []
    for slot in range(width):
        spec = F.try_element_at("_specs", F.lit(slot + 1))
        question = F.when(spec.isNotNull(), F.struct(spec["kind"].alias("kind"), spec["target"].alias("target"), F.when(~spec["anywhere"], F.col("_limit")).alias("scope"), _value(F.col("_start"), spec["source"], F.col("_known"), F.col("_tags")).alias("value")))
        rows = _ask(rows.withColumn("_question", question), answers).withColumnRenamed("_answer", f"_answer_{slot}")
        slots.append(f"_answer_{slot}")
    rows = rows.withColumn("_answers", F.filter(F.array(*slots), lambda answer: answer.isNotNull()) if slots else F.array().cast(_ANSWERS)).drop(*slots, "_specs")

    folded = _folded(rows)
    if width and _writes_before_it_looks(by_source):
        folded = durable(folded, "rule-pass")
        parts = [folded.where("_state.question is null")]
        while not (open_ := folded.where("_state.question is not null")).isEmpty():
            asked = _ask(open_.withColumn("_question", F.col("_state.question")), answers)
            again = asked.withColumn("_answers", F.concat("_answers", F.array("_answer"))).drop("_answer", "_state")
            folded = durable(_folded(again), "rule-pass")
            parts.append(folded.where("_state.question is null"))
        folded = parts[0]
        for part in parts[1:]:
            folded = folded.unionByName(part)
    outputs = {name: F.col(f"_state.{name}") for name in own if name in df.columns}
    if "additional_info" in df.columns:
        outputs["additional_info"] = F.col("_state.info")
    return folded.withColumns(outputs).select(*df.columns)


def _folded(rows: DataFrame) -> DataFrame:
    state = _fold(F.coalesce("_rules", F.array().cast(rows.schema["_rules"].dataType)), F.col("_start"), F.col("_known"), F.col("_tags"), F.col("_limit"), F.col("_answers"))
    return rows.withColumn("_state", state)


def _ask(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds `_answer`, the row's `_question` with what was found, and drops the question. Each question is one equality join."""
    keyed = rows.withColumns({"_kind": F.col("_question.kind"), "_target": F.col("_question.target"), "_scope": F.col("_question.scope"), "_value": F.col("_question.value")})
    found = lookup(keyed, answers, ["_kind", "_target", "_scope", "_value"], null_safe=("_scope",))
    answer = F.when(F.col("_question.value").isNotNull(), F.struct(F.col("_question").alias("question"), F.col("_found").alias("found")))
    return found.withColumn("_answer", answer.cast(_ANSWERS[6:-1])).drop("_kind", "_target", "_scope", "_value", "_found", "_question")


def _writes_before_it_looks(by_source: DataFrame) -> bool:
    """Does any lookup read a field that rules write?"""
    written = F.exists("specs", lambda spec: spec["source"].isin("workspace_id", "project_id", "service_account_id") | F.startswith(spec["source"], F.lit("additional_info.")))
    return not by_source.where(written).isEmpty()
