"""Dotted access into bags: `tags.env`, `additional_info.size`, `cost.USD`."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(key: str) -> Column:
    """Column for a plain name or for one key of a map or struct column."""
    head, dot, rest = key.partition(".")
    return F.col(head)[rest] if dot else F.col(head)


def output_name(item) -> str:
    """Result column of a group-by entry, either `"a.b"` or `{"key": "a.b", "name": "ab"}`."""
    if isinstance(item, dict):
        return item.get("name") or output_name(item["key"])
    return item.replace(".", "_")


def group_column(item) -> Column:
    key = item["key"] if isinstance(item, dict) else item
    return path(key).alias(output_name(item))
