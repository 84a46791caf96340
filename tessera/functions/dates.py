"""Date functions as column expressions; "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(x: Column) -> Column:
    """The first ten characters as a date, null if they are none."""
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")


def add_trading_days(day: Column, n: int) -> Column:
    """The n-th weekday after a day (no holidays)."""
    ahead = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 4)), lambda x: F.weekday(x) < 5)
    return F.get(ahead, F.lit(n - 1))


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays after a up to b; 0 if b is not after a."""
    return F.when(b > a, F.size(F.filter(F.sequence(F.date_add(a, 1), F.greatest(b, F.date_add(a, 1))), lambda x: F.weekday(x) < 5))).otherwise(F.lit(0))


def in_blackout(today: Column, report: Column, days: int = 3) -> Column:
    """Whether the report falls within so many trading days ahead."""
    return F.coalesce((report >= today) & (weekdays_between(today, report) <= days), F.lit(False))


def parse_timeframe(x: Column, today: Column) -> Column:
    """A date from a phrase: an ISO day, "N days/weeks/months/years", "Qn YYYY", soon (30), long (180), else 90 days."""
    low = F.lower(F.trim(x))
    n = F.try_to_number(F.nullif(F.regexp_extract(low, r"([0-9]{1,4})\s*(day|week|month|year)", 1), F.lit("")), F.lit("9999")).cast("int")
    unit = F.regexp_extract(low, r"[0-9]{1,4}\s*(day|week|month|year)", 1)
    quarter = F.try_to_number(F.nullif(F.regexp_extract(low, r"q([1-4])\s*[0-9]{4}", 1), F.lit("")), F.lit("9")).cast("int")
    year = F.try_to_number(F.nullif(F.regexp_extract(low, r"q[1-4]\s*([0-9]{4})", 1), F.lit("")), F.lit("9999")).cast("int")
    return (
        F.when(parse_day(low).isNotNull(), parse_day(low))
        .when(unit == "day", F.date_add(today, n))
        .when(unit == "week", F.date_add(today, n * 7))
        .when(unit == "month", F.to_date(F.add_months(today, n)))
        .when(unit == "year", F.to_date(F.add_months(today, n * 12)))
        .when(quarter.isNotNull(), F.last_day(F.make_date(year, quarter * 3, F.lit(1))))
        .when(low.contains("soon"), F.date_add(today, 30))
        .when(low.contains("long"), F.date_add(today, 180))
        .otherwise(F.date_add(today, 90))
    )


def session_minutes(ts: Column, zone: str = "America/New_York") -> Column:
    """Minutes after midnight in the market's zone of a UTC timestamp."""
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)
