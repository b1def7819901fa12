"""Registry of the bag keys that data sources have delivered, kept across loads.

A row is (data_source_id, bag, key, job_id), the job being the first that delivered the key. It is a table, not a list on the source,
so a source with millions of user-made keys stays spread over tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendframe.operators.lookups import join_null_safe
from spendframe.operators.projection import BAGS, discover_keys
from spendframe.sources.facts import FactTable

KEY = ["data_source_id", "bag", "key"]
PARTITIONS = ["data_source_id", "bag"]
SCHEMA = "data_source_id string, key string, job_id string, bag string"


def create_registry(spark, path: str) -> FactTable:
    return FactTable.create(path, spark.createDataFrame([], SCHEMA), PARTITIONS)


def register_keys(registry: FactTable, lines: DataFrame, job_id: str, bags: list[str] = BAGS) -> FactTable:
    """The registry with the keys of a load that it does not hold yet; known keys stay with their first job.

    A load that is repeated adds nothing. Only the new keys are written.
    """
    note = f"keys of {job_id}"
    fresh = join_null_safe(discover_keys(lines, bags), registry.read().select(*KEY), KEY, "left_anti")
    return registry.append(fresh.withColumn("job_id", F.lit(job_id)), note)


def visible_keys(registry: FactTable, denied: DataFrame, bag: str) -> DataFrame:
    """(data_source_id, key) of a bag without the denied fields; `denied` has rows (data_source_id, field), such as `data.tax`."""
    keys = registry.read(F.col("bag") == bag).select("data_source_id", "key")
    hidden = denied.where(F.startswith("field", F.lit(f"{bag}."))).select("data_source_id", F.substring("field", len(bag) + 2, 1 << 20).alias("key"))
    return join_null_safe(keys, hidden, ["data_source_id", "key"], "left_anti")
