"""Table schemas and the fixed values shared by the operators."""

from pyspark.sql import types as T

# Amounts and quantities of a line, and exchange rates. Nothing is rounded before the output.
MONEY = T.DecimalType(28, 12)
RATE = T.DecimalType(24, 18)

# Supported currencies and the exchange rates used when no quote is found.
CURRENCIES = ["KRW", "USD", "JPY"]
DEFAULT_RATES = {
    "KRW/USD": 0.0007156681922951203,
    "USD/KRW": 1398.6984203441723,
    "KRW/JPY": 0.10699169521856493,
    "JPY/KRW": 9.34880863101326,
    "USD/JPY": 149.73205030286636,
    "JPY/USD": 0.006686848624246231,
}
DEFAULT_EXCHANGE_SOURCE = "Yahoo! Finance"
DEFAULT_CURRENCY = "USD"
FX_WINDOW_DAYS = 15

# Retention, calendar and paging limits.
DAILY_RETENTION_MONTHS = 12
MONTHLY_RETENTION_MONTHS = 36
DEFAULT_AGGREGATION_DAY = 15
DEFAULT_EXCHANGE_DAY = 15
REPORT_RETRY_DAYS = 7
REPORT_RETRY_DAYS_MAX = 10
LAST_ORDER = 9999
COST_LIST_LIMIT = 1000
REPORT_LIST_LIMIT = 100

# What a classification rule may test.
RULE_CONDITION_KEYS = [
    "provider",
    "region_code",
    "product",
    "account",
    "usage_type",
    "resource_group",
    "resource",
]
RULE_CONDITION_BAGS = ["tags", "additional_info"]
RULE_CONDITION_OPERATORS = ["eq", "contain", "not", "not_contain"]

# Row contract of a billing source. Only billed_date must be present.
BILLING_ROW = T.StructType(
    [
        T.StructField("cost", T.DoubleType()),
        T.StructField("usage_quantity", T.DoubleType()),
        T.StructField("usage_unit", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("region_code", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("usage_type", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("additional_info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("billed_date", T.StringType()),
    ]
)

# Grouping keys of the monthly table, besides tag and additional-info keys.
ROLLUP_BATCH_KEYS = ["data_source_id", "job_id", "job_task_id", "billed_month"]
ROLLUP_KEYS = [
    "usage_unit",
    "provider",
    "region_code",
    "region_key",
    "product",
    "usage_type",
    "resource",
    "service_account_id",
    "project_id",
    "workspace_id",
    "billed_year",
]

# Grouping keys of unified cost.
UNIFIED_KEYS = [
    "workspace_id",
    "project_id",
    "service_account_id",
    "data_source_id",
    "product",
    "provider",
    "region_code",
    "region_key",
    "usage_type",
    "usage_unit",
    "billed_year",
    "billed_month",
]

# The short column list of a cost row.
COST_MINIMAL_FIELDS = [
    "cost_id",
    "cost",
    "provider",
    "region_code",
    "product",
    "usage_type",
    "resource",
    "data_source_id",
    "billed_date",
]
