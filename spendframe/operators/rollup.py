"""Daily cost to monthly cost in one shuffle for all sources, batches and months."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.functions.money import total
from spendframe.functions.predicates import definitely
from spendframe.operators.lookups import tenant
from spendframe.operators.projection import bag_of
from spendframe.schema import ROLLUP_BATCH_KEYS, ROLLUP_KEYS
from spendframe.sources.facts import FactTable, in_partitions

BAG_KEYS = ["tags", "additional_info"]
BATCH = ["data_source_id", "job_id", "billed_month"]
LINES_PER_TASK = 200_000  # a wide line with its bags takes up to 1 KB in a hash table
# Keys of the rollup that split a month whose lines name no resource.
WITHIN_MONTH = ["resource", "service_account_id", "project_id", "product", "usage_type", "region_key"]


def canonical(bag: str) -> Column:
    """A bag's non-null entries in the order of their keys: equal for equal bags, so it can be grouped by. Null is empty."""
    # Entries are never null; without a comparator they are sorted by compiled code.
    entries = F.sort_array(F.map_entries(F.map_filter(bag, lambda _, value: value.isNotNull())))
    return F.coalesce(entries, F.array().cast("array<struct<key: string, value: string>>"))


def monthly_rollup(cost: DataFrame, data_keys: list[str] | None = None) -> DataFrame:
    """Group by the fixed keys and all tags and additional info; sum cost, quantity and each data key.

    A bag is one grouping key, its sorted entries, so any number of tag keys costs no column and no look at the data
    first; an absent key and a null value are the same. Account ids are not a grouping key, so monthly rows have none. Data keys that the
    source has announced (`data_keys`) are summed in the same shuffle and are zero where a group has none. Without them
    each key found is summed, by one more, smaller shuffle, and is absent where a group has none. Tables without bags are
    rolled up without.
    """
    keys = [*tenant(cost), *ROLLUP_BATCH_KEYS, *ROLLUP_KEYS]
    bags = [bag for bag in BAG_KEYS if bag in cost.columns]
    grouping = [*keys, *bags]
    columns = [*keys, *[canonical(bag).alias(bag) for bag in bags], "cost", "usage_quantity"]
    sums = [total(F.col(name)).alias(name) for name in ("cost", "usage_quantity")]
    if "data" not in cost.columns:
        rolled = cost.select(*columns).groupBy(*grouping).agg(*sums)
    elif data_keys is not None:
        values = [F.col("data")[key].alias(f"data_{key}") for key in data_keys]
        sums += [total(F.col(f"data_{key}")).alias(f"data_{key}") for key in data_keys]
        rolled = cost.select(*columns, *values).groupBy(*grouping).agg(*sums)
        data = bag_of({key: F.col(f"data_{key}") for key in data_keys}) if data_keys else F.lit(None).cast(cost.schema["data"].dataType)
        rolled = rolled.withColumn("data", data).drop(*[f"data_{key}" for key in data_keys])
    else:
        rolled = _with_found_keys(cost, columns, grouping, sums)
    return rolled.withColumns({bag: F.map_from_entries(bag) for bag in bags})


def _with_found_keys(cost: DataFrame, columns: list, grouping: list[str], sums: list[Column]) -> DataFrame:
    """Each line is split into one row for cost and quantity and one for every data entry."""
    value = cost.schema["data"].dataType.valueType.simpleString()
    none = F.lit(None).cast(value)
    own = F.struct(F.lit(None).cast("string").alias("data_key"), none.alias("data_value"), "cost", "usage_quantity")
    nothing = [F.lit(None).cast(cost.schema[name].dataType).alias(name) for name in ("cost", "usage_quantity")]
    entries = F.transform(F.map_entries("data"), lambda entry: F.struct(entry["key"].alias("data_key"), entry["value"].alias("data_value"), *nothing))
    parts = F.concat(F.array(own), F.coalesce(entries, F.array().cast(f"array<struct<data_key: string, data_value: {value}, cost: {_type(cost, 'cost')}, usage_quantity: {_type(cost, 'usage_quantity')}>>")))
    split = cost.select(*columns[:-2], F.inline(parts)).groupBy(*grouping, "data_key").agg(*sums, total(F.col("data_value")).alias("data_value"))
    entry = F.when(F.col("data_key").isNotNull(), F.struct("data_key", "data_value"))
    return split.groupBy(*grouping).agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("data"))


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def in_batches(batches: list[tuple]) -> Column:
    """Rows of the given (data_source_id, job_id, billed_month)."""
    return in_partitions(batches, BATCH)


def refresh_monthly(
    daily: FactTable, monthly: FactTable, batches: DataFrame, data_keys: list[str] | None = None, removed: Column | None = None
) -> FactTable:
    """The monthly table with the given (data_source_id, job_id, billed_month) rolled up again from the daily lines.

    Only these groups are read from the daily table and replaced in the monthly one; monthly rows of other jobs or
    months, also of months whose daily lines have been retired, stay. `removed` names further monthly rows to drop in the
    same step. A batch that the daily table no longer holds leaves the monthly table.
    """
    listed = [tuple(row) for row in batches.select(*BATCH).distinct().collect()]  # sources x jobs x months of a load
    places = in_partitions(sorted({(source, month) for source, _, month in listed}, key=str), daily.partitions)
    lines = daily.read(places).where(in_batches(listed))
    # Moved once, by ranges of grouping keys that begin with the table's partitions: neither the rollup nor the write moves rows again.
    lines = lines.repartitionByRange(lines.count() // LINES_PER_TASK + 1, *monthly.partitions, *WITHIN_MONTH)
    again = monthly_rollup(lines, data_keys)
    gone = definitely(in_batches(listed)) if removed is None else definitely(in_batches(listed)) | definitely(removed)
    return monthly.rewrite(gone, again, clustered=True)
