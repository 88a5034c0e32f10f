"""Date parsing, month keys and season codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAY_PREFIX = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "


def _try_date(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def _two_digit_year(text: Column) -> Column:
    """dd/MM/yy with the usual pivot: 69..99 belong to the 1900s."""
    d = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _try_date(text, "d/M/yy"))
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_match_date(text: Column, formats: tuple[str, ...] = ("dmy2", "dmy4", "iso", "weekday")) -> Column:
    """First format that fits, else null."""
    t = F.trim(text)
    parsers = {
        "dmy2": lambda: _two_digit_year(t),
        "dmy4": lambda: F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _try_date(t, "d/M/yyyy")),
        "iso": lambda: F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _try_date(t, "yyyy-M-d")),
        "weekday": lambda: F.when(t.rlike(WEEKDAY_PREFIX), _try_date(F.substring(t, 5, 30), "MMM d yyyy")),
    }
    return F.coalesce(*[parsers[f]() for f in formats])


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def next_month_key(d: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(d, "month"), 1), "yyyy-MM")


def month_range(first: Column, last: Column) -> Column:
    """Array of month starts from first to last, inclusive."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def days_between(a: Column, b: Column, default: int = 7) -> Column:
    return F.coalesce(F.datediff(b, a), F.lit(default))


def season_of_date(d: Column, calendar_year: Column) -> Column:
    """Start year of the season a date falls in (seasons turn in July unless calendar-year)."""
    return F.when(calendar_year | (F.month(d) >= 7), F.year(d)).otherwise(F.year(d) - 1)


def season_code(start_year: Column) -> Column:
    """2025 -> '2025-26'."""
    return F.concat(start_year.cast("string"), F.lit("-"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def compact_season(season: Column) -> Column:
    """'2025-26' -> '2526'."""
    return F.concat(F.substring(season, 3, 2), F.substring(season, 6, 2))


def long_season(season: Column, calendar_year: Column) -> Column:
    """'2025-26' -> '2025/2026', or '2026' for calendar-year leagues."""
    start, end = F.substring(season, 1, 4), F.substring(season, 6, 2)
    closing = F.concat(F.substring(start, 1, 2), end)
    return F.when(calendar_year, closing).otherwise(F.concat(start, F.lit("/"), closing))


def season_start_id(season: Column, calendar_year: Column) -> Column:
    start = F.substring(season, 1, 4).cast("int")
    return F.when(calendar_year, start + 1).otherwise(start)


def trailing_year(label: Column) -> Column:
    """'2016/2017' and '2017' -> '2017'; null when the label does not end in four digits."""
    return F.nullif(F.regexp_extract(label, r"(\d{4})\s*$", 1), F.lit(""))
