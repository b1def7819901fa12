"""Query registry: a key, a function (spark, sf_dir) -> DataFrame, and the equivalent SQL."""

from spendframe.plans.views import with_views

QUERIES = {}
ORACLES = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = with_views(sql, views)
        return function

    return register
