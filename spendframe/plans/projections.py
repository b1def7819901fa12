"""Projection and derivation."""

from pyspark.sql import functions as F

from spendframe.functions.money import as_double, total
from spendframe.functions.paths import path
from spendframe.operators import fx, projection
from spendframe.plans.registry import query
from spendframe.plans.views import exact_product
from spendframe.schema import COST_MINIMAL_FIELDS
from spendframe.session import literal_rows, new_path
from spendframe.sources import keys, sample


@query(
    "prj_billing_period",
    "SELECT cost_id, billed_date, billed_year, billed_month FROM cost",
    ("cost",),
)
def prj_billing_period(spark, sf_dir):
    return projection.with_billing_period(sample.cost(spark, sf_dir, "cost_id", "billed_date"))


@query(
    "prj_region_key",
    "SELECT cost_id, provider, region_code, provider || '.' || region_code AS region_key FROM billing",
    ("billing",),
)
def prj_region_key(spark, sf_dir):
    rows = sample.billing_rows(spark, sf_dir).select("cost_id", "provider", "region_code")
    return projection.with_region_key(rows)


@query(
    "prj_nested_path",
    """
SELECT tag_status AS status, info_size AS size, CAST(sum(data_discount) AS double) AS discount, count(*) AS row_count
FROM cost GROUP BY ALL
""",
    ("cost",),
)
def prj_nested_path(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "tags", "additional_info", "data")
    flat = rows.select(
        path("tags.status").alias("status"),
        path("additional_info.size").alias("size"),
        path("data.discount").alias("discount"),
    )
    grouped = flat.groupBy("status", "size").agg(F.sum("discount").alias("discount"), F.count("*").alias("row_count"))
    return as_double(grouped, "discount")


@query(
    "prj_only_fields",
    """
SELECT cost_id, CAST(CAST(cost AS decimal(38,6)) AS double) AS cost, provider, region_code, product, usage_type, resource, data_source_id,
       billed_date, tag_status AS tags_status FROM cost
""",
    ("cost",),
)
def prj_only_fields(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, *COST_MINIMAL_FIELDS, "tags")
    return as_double(projection.only_fields(rows, [*COST_MINIMAL_FIELDS, "tags.status"]), "cost")


@query(
    "prj_deny_mask",
    """
SELECT cost_id, data_source_id, CASE WHEN data_source_id <> 'ds-1' THEN product END AS product,
       CASE WHEN data_source_id <> 'ds-1' THEN CAST(data_discount AS double) END AS data_discount
FROM cost
""",
    ("cost",),
)
def prj_deny_mask(spark, sf_dir):
    rows = sample.cost(spark, sf_dir, "cost_id", "data_source_id", "product", "data")
    masked = projection.mask_denied(rows, {"ds-1": ["data.discount", "product"]})
    return as_double(projection.bag_to_columns(masked, "data", sample.DATA_KEYS), "data_discount")


@query(
    "prj_deny_keys",
    """
SELECT DISTINCT data_source_id, 'data' AS bag, 'discount' AS key FROM cost WHERE data_source_id <> 'ds-1'
""",
    ("cost",),
)
def prj_deny_keys(spark, sf_dir):
    lines = sample.cost(spark, sf_dir, "data_source_id", "data")
    registry = keys.register_keys(keys.create_registry(spark, new_path(spark, "keys")), lines, "job", ["data"])
    denied = sample.sources(spark).select("data_source_id", F.explode("deny").alias("field"))
    return keys.visible_keys(registry, denied, "data").select("data_source_id", F.lit("data").alias("bag"), "key")


@query(
    "prj_discover_keys",
    """
SELECT DISTINCT data_source_id, 'tags' AS bag, 'priority' AS key FROM cost
UNION ALL SELECT DISTINCT data_source_id, 'tags', 'status' FROM cost WHERE tag_status IS NOT NULL
UNION ALL SELECT DISTINCT data_source_id, 'additional_info', 'size' FROM cost
UNION ALL SELECT DISTINCT data_source_id, 'data', 'discount' FROM cost
""",
    ("cost",),
)
def prj_discover_keys(spark, sf_dir):
    return projection.discover_keys(sample.cost(spark, sf_dir, "data_source_id", "tags", "additional_info", "data"))


@query(
    "prj_key_registry",
    """
WITH seen AS (
  SELECT data_source_id, 'tags' AS bag, 'priority' AS key, billed_year FROM cost
  UNION ALL SELECT data_source_id, 'tags', 'status', billed_year FROM cost WHERE tag_status IS NOT NULL
  UNION ALL SELECT data_source_id, 'additional_info', 'size', billed_year FROM cost
  UNION ALL SELECT data_source_id, 'data', 'discount', billed_year FROM cost)
SELECT data_source_id, bag, key, CASE WHEN min(billed_year) < '1995' THEN 'job-first' ELSE 'job-second' END AS job_id
FROM seen GROUP BY ALL
""",
    ("cost",),
)
def prj_key_registry(spark, sf_dir):
    """The keys of two loads, the second of which delivers the years from 1995 on and is repeated."""
    lines = sample.cost(spark, sf_dir, "data_source_id", "billed_year", "tags", "additional_info", "data")
    registry = keys.create_registry(spark, new_path(spark, "keys"))
    registry = keys.register_keys(registry, lines.where("billed_year < '1995'"), "job-first")
    for _ in range(2):
        registry = keys.register_keys(registry, lines.where("billed_year >= '1995'"), "job-second")
    return registry.read().select(*keys.KEY, "job_id")


@query(
    "prj_bag_to_columns",
    "SELECT cost_id, tag_priority AS tags_priority, tag_status AS tags_status FROM cost",
    ("cost",),
)
def prj_bag_to_columns(spark, sf_dir):
    return projection.bag_to_columns(sample.cost(spark, sf_dir, "cost_id", "tags"), "tags", sample.TAG_KEYS)


@query(
    "prj_columns_to_bag",
    """
SELECT cost_id, 'priority' AS key, tag_priority AS value FROM cost WHERE tag_priority IS NOT NULL
UNION ALL SELECT cost_id, 'status', tag_status FROM cost WHERE tag_status IS NOT NULL
""",
    ("cost",),
)
def prj_columns_to_bag(spark, sf_dir):
    rows = projection.bag_to_columns(sample.cost(spark, sf_dir, "cost_id", "tags"), "tags", sample.TAG_KEYS)
    nested = projection.columns_to_bag(rows, "tags", sample.TAG_KEYS)
    return nested.select("cost_id", F.explode("tags"))


def _amounts_by_source(spark, sf_dir):
    """Totals per workspace and source, converted at one date."""
    rows = sample.cost(spark, sf_dir, "workspace_id", "data_source_id", "cost")
    grouped = rows.groupBy("workspace_id", "data_source_id").agg(total(F.col("cost")).alias("cost"))
    currency = sample.sources(spark).select("data_source_id", "currency")
    day = literal_rows(spark, [(sample.AS_OF,)], "as_of string").select(F.to_date("as_of").alias("as_of"))
    rates = fx.with_defaults(fx.asof_rates_for(day, sample.fx_quotes(spark, sf_dir)), day)
    return fx.convert(grouped.join(currency, "data_source_id"), fx.rate_matrix(rates))


_CONVERTED_SQL = """
WITH day_rate AS (
  SELECT p.from_currency, p.to_currency,
         CASE WHEN p.from_currency = p.to_currency THEN p.base
              ELSE coalesce((SELECT q.close FROM fx_quote q
                WHERE q.from_currency = p.from_currency AND q.to_currency = p.to_currency
                  AND q.date BETWEEN DATE '1998-08-05' AND DATE '1998-08-20' ORDER BY q.date DESC LIMIT 1), p.base) END AS rate
  FROM pair p),
amount AS (
  SELECT c.workspace_id, c.data_source_id, s.currency, CAST(sum(c.cost) AS decimal(28,12)) AS cost
  FROM cost c JOIN source s USING (data_source_id) GROUP BY ALL)
"""


@query(
    "prj_currency_pivot",
    _CONVERTED_SQL
    + f"""
SELECT workspace_id, data_source_id, to_currency AS currency,
       CAST(CAST({exact_product("cost", "rate")} AS decimal(38,2)) AS double) AS cost
FROM amount JOIN day_rate ON from_currency = currency
""",
    ("cost", "source", "fx_quote", "pair"),
)
def prj_currency_pivot(spark, sf_dir):
    nested = projection.nest_currencies(_amounts_by_source(spark, sf_dir).drop("currency"))
    flat = projection.flatten_currencies(nested)
    return as_double(projection.unpivot_currencies(flat, ["workspace_id", "data_source_id"]), "cost", scale=2)


@query(
    "prj_fx_convert",
    _CONVERTED_SQL
    + f"""
SELECT workspace_id, data_source_id, currency,
       CAST(CAST(max(CASE WHEN to_currency = 'KRW' THEN {exact_product("cost", "rate")} END) AS decimal(38,2)) AS double) AS "cost_KRW",
       CAST(CAST(max(CASE WHEN to_currency = 'USD' THEN {exact_product("cost", "rate")} END) AS decimal(38,2)) AS double) AS "cost_USD",
       CAST(CAST(max(CASE WHEN to_currency = 'JPY' THEN {exact_product("cost", "rate")} END) AS decimal(38,2)) AS double) AS "cost_JPY"
FROM amount JOIN day_rate ON from_currency = currency GROUP BY ALL
""",
    ("cost", "source", "fx_quote", "pair"),
)
def prj_fx_convert(spark, sf_dir):
    return as_double(_amounts_by_source(spark, sf_dir), "cost_KRW", "cost_USD", "cost_JPY", scale=2)
