"""Exchange rates: as-of lookup with a bounded window, fixed fallbacks, conversion."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.schema import CURRENCIES, DEFAULT_RATES, FX_WINDOW_DAYS, MONEY, RATE


def asof_rates(quotes: DataFrame, as_of: str, window_days: int = FX_WINDOW_DAYS) -> DataFrame:
    """Latest close per ordered pair on or before `as_of`, looking back `window_days` at most.

    Columns: from_currency, to_currency, rate, rate_date. A pair of equal currencies is always 1.
    """
    day = F.to_date(F.lit(as_of))
    recent = quotes.where(F.col("date").between(F.date_sub(day, window_days), day) & F.col("close").isNotNull())
    found = recent.groupBy("from_currency", "to_currency").agg(
        F.max_by("close", "date").alias("rate"), F.max("date").alias("rate_date")
    )
    return found.withColumn("rate", _unit_for_same(F.col("rate")))


def asof_rates_for(dates: DataFrame, quotes: DataFrame, window_days: int = FX_WINDOW_DAYS) -> DataFrame:
    """As-of rates for every `as_of` date of a table.

    A quote can only serve the dates up to `window_days` after it, so each quote is listed under
    those dates and the range condition becomes an equality.
    """
    served = F.sequence(F.col("date"), F.date_add("date", window_days))
    offered = quotes.where(F.col("close").isNotNull()).withColumn("as_of", F.explode(served))
    wanted = dates.select("as_of").distinct()
    return (
        offered.join(wanted, "as_of", "left_semi")
        .groupBy("as_of", "from_currency", "to_currency")
        .agg(F.max_by("close", "date").alias("rate"), F.max("date").alias("rate_date"))
        .withColumn("rate", _unit_for_same(F.col("rate")))
    )


def _unit_for_same(rate: Column) -> Column:
    same = F.col("from_currency") == F.col("to_currency")
    return F.when(same, F.lit(1).cast(RATE)).otherwise(rate.cast(RATE))


def fallback_rates(defaults: dict[str, float] = DEFAULT_RATES) -> list[tuple[str, str, Decimal]]:
    """(from, to, rate) for every ordered pair of supported currencies; 1 for equal ones."""
    rows = []
    for source in CURRENCIES:
        for target in CURRENCIES:
            if source == target:
                rate = Decimal(1)
            elif f"{source}/{target}" in defaults:
                rate = Decimal(str(defaults[f"{source}/{target}"]))
            else:
                raise ValueError(f"no fallback rate for {source}/{target}")
            rows.append((source, target, rate.quantize(Decimal(1).scaleb(-RATE.scale))))
    return rows


def pair_structs(defaults: dict[str, float] = DEFAULT_RATES) -> Column:
    """The fallback rates as an array column of {from_currency, to_currency, default_rate}."""
    return F.array(
        *[
            F.struct(
                F.lit(source).alias("from_currency"),
                F.lit(target).alias("to_currency"),
                F.lit(rate).cast(RATE).alias("default_rate"),
            )
            for source, target, rate in fallback_rates(defaults)
        ]
    )


def with_defaults(rates: DataFrame, dates: DataFrame, defaults: dict[str, float] = DEFAULT_RATES) -> DataFrame:
    """Complete a rate table: for each `as_of` of `dates`, pairs without a quote get the fallback rate."""
    pairs = dates.select("as_of").distinct().select("as_of", F.inline(pair_structs(defaults)))
    completed = pairs.join(rates, ["as_of", "from_currency", "to_currency"], "left")
    return completed.withColumn("rate", F.coalesce("rate", "default_rate")).drop("default_rate")


def rate_matrix(rates: DataFrame, *keys: str) -> DataFrame:
    """One row per source currency (and key) with a rate column per target: to_KRW, to_USD, to_JPY."""
    targets = [
        F.max(F.when(F.col("to_currency") == currency, F.col("rate"))).alias(f"to_{currency}")
        for currency in CURRENCIES
    ]
    return rates.groupBy(*keys, F.col("from_currency").alias("currency")).agg(*targets)


def convert(df: DataFrame, matrix: DataFrame, *keys: str, amount: str = "cost") -> DataFrame:
    """Replace `amount` in `currency` by amount_KRW, amount_USD and amount_JPY.

    The matrix has one row per currency and key date, so its size is bounded by the calendar,
    not by the data.
    """
    joined = df.join(F.broadcast(matrix), [*keys, "currency"], "left")
    value = F.col(amount).cast(MONEY)
    columns = {f"{amount}_{currency}": value * F.col(f"to_{currency}") for currency in CURRENCIES}
    return joined.withColumns(columns).drop(amount, *[f"to_{currency}" for currency in CURRENCIES])
