"""Exact sums in the pipeline, doubles at the edge."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.schema import CURRENCIES


def total(column: Column) -> Column:
    """Sum where missing values count as zero and an all-missing group gives zero."""
    return F.coalesce(F.sum(column), F.lit(0))


def as_double(df: DataFrame, *names: str, scale: int = 6) -> DataFrame:
    """Round decimal money columns and hand them out as doubles."""
    return df.withColumns({name: F.round(F.col(name), scale).cast("double") for name in names})


def currency_columns(prefix: str = "cost") -> list[str]:
    return [f"{prefix}_{currency}" for currency in CURRENCIES]
