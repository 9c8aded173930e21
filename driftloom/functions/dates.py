"""Date-hour labels, week and day numbers, date axes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_HOUR = r"20\d{2}-\d{2}-\d{2}-\d{2}"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def extract_date_hour(name: Column | str, pattern: str = DATE_HOUR) -> Column:
    """First date-hour in a name, NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(name), pattern, 0), F.lit(""))


def date_hour_to_ts(date_hour: Column | str) -> Column:
    return F.try_to_timestamp(_col(date_hour), F.lit("yyyy-MM-dd-HH")).cast("timestamp_ntz")


def year_month(date_hour: Column | str) -> Column:
    """YYYY-MM of a date-hour label."""
    return F.substring(_col(date_hour), 1, 7)


def _seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return micros / 1_000_000


def week_index(ts: Column | str, start: Column) -> Column:
    """Whole weeks since `start`, truncated toward zero."""
    return (_seconds_between(_col(ts), start) / 604_800).cast("int")


def day_index(ts: Column | str, start: Column) -> Column:
    """Whole days since `start`, truncated toward zero."""
    return (_seconds_between(_col(ts), start) / 86_400).cast("int")


def start_of(date_hour: str) -> Column:
    return date_hour_to_ts(F.lit(date_hour))


def parse_compact_date(number: Column | str) -> Column:
    """Integer yyyymmdd to a date."""
    return F.to_date(_col(number).cast("string"), "yyyyMMdd")


def date_label(slice_number: Column | str, start: str) -> Column:
    """MM-dd label of a day slice counted from `start` (yyyy-MM-dd)."""
    return F.date_format(F.date_add(F.lit(start).cast("date"), _col(slice_number).cast("int")), "MM-dd")
