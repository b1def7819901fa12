"""Monthly cost to unified cost: one currency bag and one set of names for all workspaces."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.money import total
from spendframe.functions.periods import day_in_month
from spendframe.operators.accounts import virtual_to_real
from spendframe.operators.lookups import lookup, tenant
from spendframe.operators.fx import asof_rates_for, convert, rate_matrix, with_defaults
from spendframe.schema import (
    DEFAULT_AGGREGATION_DAY,
    DEFAULT_CURRENCY,
    DEFAULT_EXCHANGE_DAY,
    DEFAULT_EXCHANGE_SOURCE,
    UNIFIED_KEYS,
)


def _day(config: dict, name: str, default: int) -> Column:
    return F.lit(int(config.get(name, default)))


def month_calendar(months: DataFrame, as_of: Column, config: dict | None = None) -> DataFrame:
    """Confirmation, aggregation date and exchange date of each `billed_month`.

    A month is confirmed one month after its aggregation day. Until then both dates are the
    as-of date.
    """
    config = config or {}
    month, today = F.col("billed_month"), F.to_date(as_of)
    aggregation = day_in_month(
        month, _day(config, "aggregation_day", DEFAULT_AGGREGATION_DAY), F.lit(bool(config.get("is_last_day")))
    )
    exchange = day_in_month(
        month, _day(config, "exchange_day", DEFAULT_EXCHANGE_DAY), F.lit(bool(config.get("is_exchange_last_day")))
    )
    confirmed = today >= F.add_months(aggregation, 1)
    return months.select(
        "billed_month",
        confirmed.alias("is_confirmed"),
        F.when(confirmed, aggregation).otherwise(today).alias("aggregation_date"),
        F.when(confirmed, exchange).otherwise(today).alias("exchange_date"),
    )


def unify(monthly: DataFrame, accounts: DataFrame, workspaces: DataFrame, sources: DataFrame) -> DataFrame:
    """Fold virtual workspaces into real ones, keep known workspaces and the null workspace, group.

    Rows of an unknown or disabled workspace, and of a source owned by another workspace, drop out.
    """
    own = tenant(monthly)
    folded = virtual_to_real(monthly.select(*own, *UNIFIED_KEYS, "cost", "usage_quantity"), _linked(accounts))
    enabled = workspaces.where(F.col("state") == "ENABLED").select(*own, "workspace_id", F.lit(True).alias("_enabled"))
    visible = sources.select(*own, "data_source_id", F.col("workspace_id").alias("_owner"))
    grouped = folded.groupBy(*own, *UNIFIED_KEYS).agg(
        total(F.col("cost")).alias("cost"), total(F.col("usage_quantity")).alias("usage_quantity")
    )
    marked = lookup(grouped, enabled, [*own, "workspace_id"])
    kept = marked.where(F.col("workspace_id").isNull() | F.col("_enabled")).drop("_enabled")
    owned = lookup(kept, visible, [*own, "data_source_id"])
    return owned.where((F.col("_owner") == "*") | (F.col("_owner") == F.col("workspace_id"))).drop("_owner")


def _linked(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.col("workspace_id").isNotNull())


def with_source_currency(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Currency and name of the data source; unknown sources count as USD and show their id."""
    own = tenant(df)
    known = sources.select(
        *own, "data_source_id", F.col("currency").alias("_currency"), F.col("name").alias("_name")
    )
    return (
        lookup(df, known, [*own, "data_source_id"])
        .withColumns(
            {
                "currency": F.coalesce("_currency", F.lit(DEFAULT_CURRENCY)),
                "data_source_name": F.coalesce("_name", "data_source_id"),
            }
        )
        .drop("_currency", "_name")
    )


def with_names(
    df: DataFrame, workspaces: DataFrame, projects: DataFrame, service_accounts: DataFrame
) -> DataFrame:
    """Names of workspace, project (default: its id) and service account (default: null).

    Projects and service accounts are looked up in the row's own workspace; rows of the null
    workspace get no names.
    """
    own = tenant(df)
    ws = workspaces.select(*own, "workspace_id", F.col("name").alias("workspace_name"))
    pj = projects.select(*own, "workspace_id", "project_id", F.col("name").alias("_project"))
    sa = service_accounts.select(*own, "workspace_id", "service_account_id", F.col("name").alias("service_account_name"))
    named = lookup(df, ws, [*own, "workspace_id"])
    named = lookup(named, pj, [*own, "workspace_id", "project_id"])
    named = lookup(named, sa, [*own, "workspace_id", "service_account_id"])
    project_name = F.when(F.col("workspace_id").isNotNull(), F.coalesce("_project", "project_id"))
    return named.withColumn("project_name", project_name).drop("_project")


def build_unified(
    monthly: DataFrame,
    months: DataFrame,
    accounts: DataFrame,
    workspaces: DataFrame,
    projects: DataFrame,
    service_accounts: DataFrame,
    sources: DataFrame,
    quotes: DataFrame,
    as_of: Column,
    config: dict | None = None,
    exchange_source: str = DEFAULT_EXCHANGE_SOURCE,
) -> DataFrame:
    """Unified cost of every month in `monthly`; pass one month's rows to rebuild that month.

    `months` lists the `billed_month` values of the input, which a run knows beforehand.
    """
    grouped = with_source_currency(unify(monthly, accounts, workspaces, sources), sources)
    calendar = month_calendar(months, as_of, config)
    dates = calendar.select(F.col("exchange_date").alias("as_of")).distinct()
    rates = with_defaults(asof_rates_for(dates, quotes), dates)
    # One row per month and currency: bounded by the calendar.
    matrix = rate_matrix(rates, "as_of")
    monthly_matrix = (
        calendar.join(matrix, F.col("exchange_date") == F.col("as_of"))
        .drop("as_of")
        .withColumns(
            {name: F.date_format(name, "yyyy-MM-dd") for name in ("aggregation_date", "exchange_date")}
        )
    )
    converted = convert(grouped, monthly_matrix, "billed_month")
    named = with_names(converted, workspaces, projects, service_accounts)
    return named.withColumn("exchange_source", F.lit(exchange_source))
