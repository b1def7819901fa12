"""Period strings: YYYY, YYYY-MM and YYYY-MM-DD, whose text order is time order."""

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_COLUMNS = {"DAILY": "billed_date", "MONTHLY": "billed_month", "YEARLY": "billed_year"}
WIDTHS = {"DAILY": 10, "MONTHLY": 7, "YEARLY": 4}
_FORMATS = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d"}


def add_to_month(month: str, count: int) -> str:
    index = int(month[:4]) * 12 + int(month[5:7]) - 1 + count
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def parse_period(text: str, granularity: str) -> date:
    text = text.strip()
    if len(text) not in _FORMATS or len(text) > WIDTHS[granularity]:
        raise ValueError(f"{text!r} is not a {granularity} period")
    return datetime.strptime(text, _FORMATS[len(text)]).date()


def period_bounds(start: str, end: str, granularity: str) -> tuple[str, str]:
    """Half-open bounds in the granularity's own width; the end is inclusive by one unit of it."""
    first, last = parse_period(start, granularity), parse_period(end, granularity)
    if granularity == "YEARLY":
        after = date(last.year + 1, 1, 1)
    elif granularity == "MONTHLY":
        after = datetime.strptime(add_to_month(f"{last:%Y-%m}", 1), "%Y-%m").date()
    else:
        after = date.fromordinal(last.toordinal() + 1)
    width = WIDTHS[granularity]
    return first.isoformat()[:width], after.isoformat()[:width]


def in_window(start: str, end: str, granularity: str, column: str | None = None) -> Column:
    """Plain string comparison on the period column, so partitions and row groups can be pruned."""
    low, high = period_bounds(start, end, granularity)
    target = F.col(column or DATE_COLUMNS[granularity])
    return (target >= low) & (target < high)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def first_day(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def months_between(start: Column, end: Column) -> Column:
    """Array of every YYYY-MM from start to end, both included; empty when end is before start."""
    steps = F.sequence(first_day(start), first_day(end), F.expr("interval 1 month"))
    return F.when(start <= end, F.transform(steps, month_of)).otherwise(F.array().cast("array<string>"))


def day_in_month(month: Column, day: Column, use_last_day: Column) -> Column:
    """Date of a configured day in a month, clamped to the month's end."""
    last = F.dayofmonth(F.last_day(first_day(month)))
    chosen = F.when(F.coalesce(use_last_day, F.lit(False)), last).otherwise(F.least(day, last))
    return F.date_add(first_day(month), chosen.cast("int") - 1)
