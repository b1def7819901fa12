"""Nothing is rounded between the billing line and the output."""

from decimal import Decimal

from pyspark.sql import functions as F

from spendframe.operators import analyze, fx
from spendframe.schema import DEFAULT_RATES, MONEY
from spendframe.sources.billing import normalise

BATCH = {"job_id": "j", "job_task_id": "t", "data_source_id": "ds"}


def lines(spark, count, cost, quantity=1.0, data=0.0):
    rows = spark.range(count).select(
        F.lit(cost).alias("cost"),
        F.lit(quantity).alias("usage_quantity"),
        F.create_map(F.lit("tax"), F.lit(data)).alias("data"),
        F.lit("aws").alias("provider"),
        F.lit("r").alias("region_code"),
        F.lit("1998-01-05").alias("billed_date"),
    )
    return normalise(rows, BATCH)


def test_many_tiny_lines_keep_their_sum(spark):
    fields = {name: {"k": key, "o": "sum"} for name, key in (("cost", "cost"), ("q", "usage_quantity"), ("tax", "data.tax"))}
    found = analyze.analyze(lines(spark, 100_000, 0.00004, 0.1, 0.000001), fields=fields, group_by=["provider"]).first()
    assert found.cost == Decimal(4) and found.q == Decimal(10_000) and found.tax == Decimal("0.1")


def test_order_and_partitions_change_no_sum(spark):
    rows = spark.range(20_000).select((F.col("id") * 0.1 + 1e-7).alias("cost"), F.lit("1998-01-05").alias("billed_date"), F.lit("a").alias("provider"), F.lit("r").alias("region_code"))
    one, many = (normalise(rows.repartition(n), BATCH).agg(F.sum("cost")).first()[0] for n in (1, 37))
    assert one == many


def test_a_billion_won(spark):
    dates = spark.createDataFrame([("1998-01-01",)], "as_of string").select(F.to_date("as_of").alias("as_of"))
    quotes = spark.createDataFrame([], "date date, from_currency string, to_currency string, close double")
    matrix = fx.rate_matrix(fx.with_defaults(fx.asof_rates_for(dates, quotes), dates), "as_of")
    amount = spark.createDataFrame([(Decimal(10**9), "KRW")], "cost decimal(20,4), currency string").select(F.col("cost").cast(MONEY).alias("cost"), "currency", F.lit("1998-01-01").cast("date").alias("as_of"))
    found = fx.convert(amount, matrix, "as_of").first()
    assert abs(found.cost_USD - Decimal(10**9) * Decimal(str(DEFAULT_RATES["KRW/USD"]))) < Decimal("1e-8")
    assert found.cost_KRW == 10**9
