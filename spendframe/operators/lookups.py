"""Row-level lookups of a fact in a dimension with unique keys.

These are plain equality joins. Adaptive execution broadcasts a side once its measured bytes allow it and
splits partitions that a hot key, or the null key of a left join, has made large; both sides keep their own
column pruning, and planning a lookup starts no job.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DOMAIN = "domain_id"


def tenant(df: DataFrame) -> list[str]:
    """The tenant's column, where a table has one: it leads the keys of every join and group, so tenants never mix."""
    return [DOMAIN] if DOMAIN in df.columns else []


def lookup(fact: DataFrame, dim: DataFrame, keys: list[str], null_safe: tuple[str, ...] = ()) -> DataFrame:
    """Left join on same-named keys; keys in `null_safe` treat null as a value."""
    renamed = dim.select(
        *[F.col(key).alias(f"_dim_{key}") for key in keys],
        *[name for name in dim.columns if name not in keys],
    )
    matches = [
        F.col(key).eqNullSafe(F.col(f"_dim_{key}")) if key in null_safe else F.col(key) == F.col(f"_dim_{key}")
        for key in keys
    ]
    joined = fact.join(renamed, reduce(lambda a, b: a & b, matches), "left")
    return joined.drop(*[f"_dim_{key}" for key in keys])


def keep_matching(fact: DataFrame, ids: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among `ids`."""
    return fact.join(ids, key, "left_anti" if negate else "left_semi")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equality join on same-named keys where null matches null; keys of the right side are dropped."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    matches = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    joined = left.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"_right_{key}" for key in keys])


def first_by(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the one with the smallest `order` value. Combines map-side, needs no window."""
    picked = F.min_by(F.struct(*values), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")
