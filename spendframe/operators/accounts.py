"""Accounts of a data source: routing of cost rows, linking to workspaces, upsert and counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.functions.paths import path
from spendframe.functions.predicates import definitely, member
from spendframe.operators.lookups import first_by, lookup, tenant


def route_accounts(cost: DataFrame, accounts: DataFrame, match_keys: dict[str, str]) -> DataFrame:
    """Give each row its real workspace and, on routed sources, the account's virtual workspace.

    `match_keys` maps the routed source ids to the field holding the account id. Adds
    `real_workspace_id` and replaces `workspace_id` by the virtual id where an account was found.
    """
    routed = F.col("data_source_id")
    account = F.lit(None).cast("string")
    for source_id, key in match_keys.items():
        account = F.when(routed == source_id, path(key)).otherwise(account)
    is_routed = definitely(routed.isin(list(match_keys)))
    own = tenant(cost)
    known = first_by(
        accounts.select(
            *own,
            "data_source_id",
            F.col("account_id").alias("_account"),
            F.col("workspace_id").alias("_real"),
            F.col("v_workspace_id").alias("_virtual"),
        ).where(F.col("_account").isNotNull()),
        [*own, "data_source_id", "_account"],
        "_virtual",
        ["_real", "_virtual"],
    )
    joined = lookup(cost.withColumn("_account", account), known, [*own, "data_source_id", "_account"])
    return joined.withColumns(
        {
            "real_workspace_id": F.when(is_routed, F.col("_real")).otherwise(F.col("workspace_id")),
            "workspace_id": F.coalesce("_virtual", "workspace_id"),
        }
    ).drop("_account", "_real", "_virtual")


def connect_accounts(accounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Link each account to the workspace that references it, else to the domain's only workspace.

    An account nobody references keeps its link when the domain has several workspaces.
    """
    own = tenant(accounts)
    references = workspaces.select(*own, "workspace_id", F.explode("references").alias("account_id"))
    owners = references.groupBy(*own, "account_id").agg(F.min("workspace_id").alias("_owner"))
    only = F.when(F.count("*") == 1, F.min("workspace_id")).alias("_only")
    if own:
        known = lookup(accounts, workspaces.groupBy(*own).agg(only), own)
    else:
        known = accounts.withColumn("_only", workspaces.agg(only).scalar())
    linked = lookup(known, owners, [*own, "account_id"])
    target = F.coalesce("_owner", "_only")
    return linked.withColumns(
        {
            "is_linked": target.isNotNull() | F.coalesce("is_linked", F.lit(False)),
            "workspace_id": F.coalesce(target, "workspace_id"),
        }
    ).drop("_owner", "_only")


def upsert_accounts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New accounts are added, changed names taken over, nothing is removed."""
    keys = [*tenant(existing), "data_source_id", "account_id"]
    fresh = incoming.select(*keys, F.col("name").alias("_name"), F.lit(True).alias("_incoming"))
    merged = existing.withColumn("_existing", F.lit(True)).join(fresh, keys, "full")
    action = (
        F.when(F.col("_existing").isNull(), "inserted")
        .when(F.col("_incoming") & ~F.col("name").eqNullSafe(F.col("_name")), "renamed")
        .otherwise("kept")
    )
    name = F.when(F.col("_incoming"), F.col("_name")).otherwise(F.col("name"))
    return merged.withColumn("change", action).withColumn("name", name).drop("_name", "_incoming", "_existing")


def virtual_to_real(df: DataFrame, accounts: DataFrame, column: str = "workspace_id") -> DataFrame:
    """Replace virtual workspace ids by the real ones; ids without an account stay."""
    own = tenant(df)
    real = first_by(
        accounts.select(*own, F.col("v_workspace_id").alias(column), F.col("workspace_id").alias("_real"), "account_id"),
        [*own, column],
        "account_id",
        ["_real"],
    ).withColumn("_known", F.lit(True))
    joined = lookup(df, real, [*own, column])
    return joined.withColumn(
        column, F.when(F.col("_known"), F.col("_real")).otherwise(F.col(column))
    ).drop("_real", "_known")


def account_counts(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts and distinct linked workspaces per source; workspace sources count their own only."""
    scoped = accounts.select("data_source_id", "account_id", F.col("workspace_id").alias("_linked")).join(
        sources.select("data_source_id", "resource_group", F.col("workspace_id").alias("_owner")), "data_source_id"
    )
    own = (F.col("resource_group") != "WORKSPACE") | definitely(F.col("_linked") == F.col("_owner"))
    counts = (
        scoped.where(own)
        .groupBy("data_source_id")
        .agg(
            F.count("*").alias("data_source_account_count"),
            F.count_distinct("_linked").alias("connected_workspace_count"),
        )
    )
    return (
        sources.select("data_source_id")
        .join(counts, "data_source_id", "left")
        .na.fill(0, ["data_source_account_count", "connected_workspace_count"])
    )


def connected_sources(sources: DataFrame, accounts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace_id, source columns): the sources that each workspace of a table can see.

    Routed domain sources are seen by workspaces with a linked account. Workspace sources and unrouted domain sources
    are seen by all: they are listed once, with a null workspace, rather than once for every workspace.
    """
    asking = workspaces.select("workspace_id").distinct()
    named = sources.withColumnRenamed("workspace_id", "owner_workspace_id")
    is_open = (F.col("resource_group") != "DOMAIN") | ~F.coalesce("use_account_routing", F.lit(False))
    linked = accounts.join(asking, "workspace_id", "left_semi").select("workspace_id", "data_source_id").distinct()
    by_link = linked.join(named.where(~is_open), "data_source_id")
    by_all = named.where(is_open).withColumn("workspace_id", F.lit(None).cast("string"))
    return by_all.unionByName(by_link)


def config_sources(configs: DataFrame, sources: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(cost_report_config_id, data_source_id): the sources that each report config draws on, within its tenant.

    A config may list source ids (`data_sources`; null or none means all) and names a schedule state (`source_state`, null
    meaning ENABLED). A source counts if it belongs to all workspaces or to a known one.
    """
    own = tenant(configs)
    known = workspaces.select(*own, "workspace_id").distinct()
    shared = sources.where(F.col("workspace_id") == "*")
    held = shared.unionByName(sources.join(known, [*own, "workspace_id"], "left_semi").select(*sources.columns))
    wanted = configs.select(*own, "cost_report_config_id", F.coalesce("source_state", F.lit("ENABLED")).alias("schedule_state"), "data_sources")
    listed = wanted.where(F.size("data_sources") > 0).withColumn("data_source_id", F.explode(F.array_distinct("data_sources"))).drop("data_sources")
    every = wanted.where(F.coalesce(F.size("data_sources"), F.lit(0)) <= 0).drop("data_sources")
    held = held.select(*own, "schedule_state", "data_source_id").distinct()
    found = listed.join(held, [*own, "schedule_state", "data_source_id"]).unionByName(every.join(held, [*own, "schedule_state"]).select(*listed.columns))
    return found.select(*own, "cost_report_config_id", "data_source_id")


def report_sources(
    sources: DataFrame, workspace_ids: list[str], only: list[str] | None = None, state: str | None = "ENABLED"
) -> DataFrame:
    """Sources feeding a report: shared or of the given workspaces, with the wanted schedule state."""
    kept = sources.where(member(F.col("workspace_id"), [*workspace_ids, "*"]))
    if only:
        kept = kept.where(F.col("data_source_id").isin(only))
    return kept.where(F.col("schedule_state") == state) if state else kept
