"""Derived columns, field lists, masking and the bag/column conversions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.paths import path
from spendframe.schema import CURRENCIES

BAGS = ["tags", "additional_info", "data"]


def with_billing_period(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "billed_year": F.substring("billed_date", 1, 4),
            "billed_month": F.substring("billed_date", 1, 7),
        }
    )


def with_region_key(df: DataFrame) -> DataFrame:
    """`provider.region_code`, only when both are known."""
    return df.withColumn("region_key", F.concat(F.col("provider"), F.lit("."), F.col("region_code")))


def only_fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[path(name).alias(name.replace(".", "_")) for name in names])


def mask_denied(df: DataFrame, denied: dict[str, list[str]]) -> DataFrame:
    """Blank the denied fields of each data source; `denied` maps a source id to field paths."""
    owners: dict[str, list[str]] = {}
    for source_id, fields in denied.items():
        for field in fields:
            owners.setdefault(field, []).append(source_id)
    columns = {}
    for field, source_ids in owners.items():
        head, dot, key = field.partition(".")
        hidden = F.coalesce(F.col("data_source_id").isin(source_ids), F.lit(False))
        current = columns.get(head, F.col(head))
        if dot:
            columns[head] = _blank_key(current, key, hidden)
        else:
            columns[head] = F.when(~hidden, current)
    return df.withColumns(columns)


def _blank_key(bag: Column, key: str, hidden: Column) -> Column:
    return F.transform_values(bag, lambda name, value: F.when(~(hidden & (name == key)), value))


def discover_keys(df: DataFrame, bags: list[str] = BAGS) -> DataFrame:
    """Distinct (data_source_id, bag, key); duplicates collapse before the shuffle."""
    entries = F.concat(*[_named_keys(bag) for bag in bags])
    return df.select("data_source_id", F.inline(entries)).distinct()


def _named_keys(bag: str) -> Column:
    keys = F.coalesce(F.map_keys(bag), F.array().cast("array<string>"))
    return F.transform(keys, lambda key: F.struct(F.lit(bag).alias("bag"), key.alias("key")))


def bag_to_columns(df: DataFrame, bag: str, keys: list[str]) -> DataFrame:
    return df.select("*", *[F.col(bag)[key].alias(f"{bag}_{key}") for key in keys]).drop(bag)


def bag_of(pairs: dict):
    """Map of the non-null values; `pairs` maps keys to Columns."""
    entries = [part for key, value in pairs.items() for part in (F.lit(key), value)]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def columns_to_bag(df: DataFrame, bag: str, keys: list[str]) -> DataFrame:
    names = [f"{bag}_{key}" for key in keys]
    return df.withColumn(bag, bag_of({key: F.col(name) for key, name in zip(keys, names)})).drop(*names)


def nest_currencies(df: DataFrame, name: str = "cost") -> DataFrame:
    """`cost_KRW, cost_USD, cost_JPY` to one struct `cost`."""
    flat = [f"{name}_{currency}" for currency in CURRENCIES]
    nested = F.struct(*[F.col(column).alias(currency) for column, currency in zip(flat, CURRENCIES)])
    return df.withColumn(name, nested).drop(*flat)


def flatten_currencies(df: DataFrame, name: str = "cost") -> DataFrame:
    flat = {f"{name}_{currency}": F.col(f"{name}.{currency}") for currency in CURRENCIES}
    return df.withColumns(flat).drop(name)


def unpivot_currencies(df: DataFrame, ids: list[str], name: str = "cost") -> DataFrame:
    """One row per currency."""
    wide = df.select(*ids, *[F.col(f"{name}_{currency}").alias(currency) for currency in CURRENCIES])
    return wide.unpivot(ids, CURRENCIES, "currency", name)
