"""Row filters that need more than one column: project groups, virtual workspaces, report status."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.functions.predicates import condition, member, where
from spendframe.operators.lookups import keep_matching
from spendframe.session import durable, literal_rows


def scoped(df: DataFrame, **scope) -> DataFrame:
    """Tenancy columns: each given value narrows the rows, None leaves the column alone."""
    specs = [
        {"k": key, "v": value, "o": "in" if isinstance(value, (list, tuple)) else "eq"}
        for key, value in scope.items()
        if value is not None
    ]
    return df.where(where(specs))


def visible_to_projects(df: DataFrame, project_ids: list[str]) -> DataFrame:
    """Rows of the user's projects and rows of no project."""
    return df.where(member(F.col("project_id"), list(project_ids) + [None]))


def group_closure(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of the root groups and of all their descendants, at any depth.

    Every group points at an ancestor and knows whether a root stands between; each round doubles the
    distance, so a tree of n levels takes about log2(n) rounds. A round is a written table. Pointers inside a cycle
    never end; after as many doublings as there are groups nothing new can be found.
    """
    roots = roots.select("project_group_id").distinct()
    known = groups.select("project_group_id", F.col("parent_group_id").alias("above"))
    loose = roots.join(known, "project_group_id", "left_anti").withColumn("above", F.lit(None).cast("string"))
    marked = known.unionByName(loose).join(roots.withColumn("hit", F.lit(True)), "project_group_id", "left")
    state = durable(marked.withColumn("hit", F.coalesce("hit", F.lit(False))), "groups")
    count, reach = state.count(), 1
    while reach <= count and not state.where("above is not null and not hit").isEmpty():
        upper = state.select(
            F.col("project_group_id").alias("above"), F.col("above").alias("further"), F.col("hit").alias("also")
        )
        joined = state.join(upper, "above", "left")
        moved = joined.groupBy("project_group_id", F.col("further").alias("above")).agg(
            F.max(F.col("hit") | F.coalesce("also", F.lit(False))).alias("hit")
        )
        state, reach = durable(moved, "groups"), 2 * reach
    return state.where("hit").select("project_group_id").distinct()


def in_project_groups(df: DataFrame, spec: dict, groups: DataFrame, projects: DataFrame) -> DataFrame:
    """`project_group_id` condition: keep rows whose project is in a matching group or below it."""
    closure = group_closure(groups, groups.where(condition(spec)))
    ids = projects.join(closure, "project_group_id", "left_semi").select("project_id").distinct()
    return keep_matching(df, ids, "project_id")


def in_workspaces(df: DataFrame, workspace_ids: list[str], accounts: DataFrame, negate: bool = False) -> DataFrame:
    """Workspace condition under account routing.

    Rows carry the virtual id of their account. A listed workspace with accounts is replaced by
    the virtual ids of those accounts; one without accounts is kept as it is.
    """
    listed = literal_rows(df.sparkSession, [(value,) for value in workspace_ids], "workspace_id string")
    linked = accounts.join(listed, "workspace_id", "left_semi")
    ids = (
        linked.select(F.col("v_workspace_id").alias("workspace_id"))
        .union(listed.join(linked, "workspace_id", "left_anti"))
        .distinct()
    )
    return keep_matching(df, ids, "workspace_id", negate)


def listed_reports(reports: DataFrame, status: str | None, conditions=()) -> DataFrame:
    """A status argument without a status condition lists finished reports only."""
    has_status = any(spec.get("k", spec.get("key")) == "status" for spec in conditions)
    kept = reports.where(where(conditions))
    return kept.where(F.col("status") == "DONE") if status and not has_status else kept
