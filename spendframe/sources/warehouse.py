"""Data sources of type WAREHOUSE: their questions read warehouse tables instead of the cost tables."""

from pyspark.sql import DataFrame, SparkSession

from spendframe.operators.analyze import analyze, distinct_values

# Fixed value: the warehouse kind a source may name.
SUPPORTED = ["DATABRICKS"]


def is_warehouse(source: dict) -> bool:
    return source.get("data_source_type") == "WAREHOUSE"


def table_name(source: dict, warehouses: dict, granularity: str) -> str:
    """Qualified table of a source's provider and granularity."""
    kind = source["warehouse_info"]["type"]
    if kind not in SUPPORTED:
        raise ValueError(f"unsupported warehouse type: {kind}")
    place = warehouses[kind][source["provider"]]
    parts = [place.get("catalog"), place.get("schema"), place["table"][granularity]]
    return ".".join(part for part in parts if part)


def cost_table(
    spark: SparkSession, source: dict, granularity: str, local: dict[str, DataFrame], warehouses: dict
) -> DataFrame:
    """Table to ask: the warehouse's for a warehouse source, else daily or monthly from `local`."""
    if is_warehouse(source):
        return spark.table(table_name(source, warehouses, granularity))
    return local["DAILY" if granularity == "DAILY" else "MONTHLY"]


def analyze_source(spark, source, granularity, local, warehouses, **query) -> DataFrame:
    table = cost_table(spark, source, granularity, local, warehouses)
    return analyze(table, granularity=granularity, **query)


def distinct_of_source(spark, source, key, local, warehouses, **query) -> DataFrame:
    return distinct_values(cost_table(spark, source, "MONTHLY", local, warehouses), key, **query)
