"""Filter conditions `{k, v, o}` compiled to one boolean Column.

Every predicate is two-valued: a null field never makes a condition null, so conditions
can be negated and combined freely.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendframe.functions.paths import path


def definitely(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive substring test."""
    return definitely(F.contains(F.lower(column), F.lit(text.lower())))


def member(column: Column, values) -> Column:
    """`in`: a None among the values also accepts null."""
    present = [value for value in values if value is not None]
    hit = definitely(column.isin(present)) if present else F.lit(False)
    return hit | column.isNull() if None in values else hit


def compare(column: Column, operator: str, value) -> Column:
    if operator == "eq":
        return column.isNull() if value is None else definitely(column == value)
    if operator == "not":
        return ~column.eqNullSafe(F.lit(value))
    if operator == "in":
        return member(column, value)
    if operator == "not_in":
        return ~member(column, value)
    if operator == "gt":
        return definitely(column > value)
    if operator == "gte":
        return definitely(column >= value)
    if operator == "lt":
        return definitely(column < value)
    if operator == "lte":
        return definitely(column <= value)
    if operator == "contain":
        return contains(column, value)
    if operator == "not_contain":
        return ~contains(column, value)
    raise ValueError(f"unsupported operator: {operator}")


def condition(spec: dict, resolve=path) -> Column:
    """Compile one condition; `resolve` turns a key into a Column."""
    key = spec.get("k", spec.get("key"))
    value = spec.get("v", spec.get("value"))
    operator = spec.get("o", spec.get("operator", "eq"))
    if key == "user_projects":
        return member(resolve("project_id"), list(value) + [None])
    return compare(resolve(key), operator, value)


def where(conditions=(), either=()) -> Column:
    """AND of `conditions`, ANDed with the OR of `either` when that list is not empty."""
    parts = [condition(spec) for spec in conditions or ()]
    if either:
        parts.append(any_of([condition(spec) for spec in either]))
    return all_of(parts)


def keyword(text: str, columns) -> Column:
    """Free-text search: each word must occur in at least one of the columns."""
    return all_of([any_of([contains(path(name), word) for name in columns]) for word in text.split()])
