"""Runs a registered query on Spark and its SQL on DuckDB and compares rows and values.

Also refuses plans that pair rows without a key or leave the JVM.
"""

import math
from contextlib import contextmanager

import duckdb
from pyspark.sql import DataFrameWriter

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if math.isnan(value) else repr(value)
    return str(value)


BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow")


def banned_nodes(frame) -> list[str]:
    plan = frame._jdf.queryExecution().toString()
    return [node for node in BANNED if node in plan]


@contextmanager
def watched_writes(found: list[str]):
    """Looks at the plan of every table that is written meanwhile."""
    write = DataFrameWriter.parquet

    def checked(self, path, *args, **kwargs):
        found.extend(banned_nodes(self._df))
        return write(self, path, *args, **kwargs)

    DataFrameWriter.parquet = checked
    try:
        yield
    finally:
        DataFrameWriter.parquet = write


def difference(spark, query, connection, sql: str, sf_dir: str) -> str | None:
    """None when both give the same rows, else a short description."""
    banned: list[str] = []
    with watched_writes(banned):
        frame = query(spark, sf_dir)
    banned += banned_nodes(frame)
    if banned:
        return f"plan has {banned}"
    names = sorted(frame.columns)
    arrow = frame.select(*[f"`{name}`" for name in names]).toArrow()
    cursor = connection.execute(sql)
    other_names = [item[0] for item in cursor.description]
    if sorted(other_names) != names:
        return f"columns {names} vs {sorted(other_names)}"
    positions = [other_names.index(name) for name in names]
    theirs = sorted(tuple(_cell(row[p]) for p in positions) for row in cursor.fetchall())
    columns = [arrow.column(i).to_pylist() for i in range(arrow.num_columns)]
    ours = sorted(tuple(_cell(value) for value in row) for row in zip(*columns))
    if ours == theirs:
        return None if ours else "both empty"
    missing = [row for row in theirs if row not in set(ours)][:2]
    extra = [row for row in ours if row not in set(theirs)][:2]
    return f"{len(ours)} rows vs {len(theirs)}; only spark {extra}; only sql {missing}"
