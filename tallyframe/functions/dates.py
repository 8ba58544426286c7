"""Date expressions. Every "today" is an argument, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = Column | dt.date | str
# Texts that a format and a cast read alike, which they do except in the year 0.
COMMON_FORMS = {
    "yyyy-MM-dd": r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "yyyy-MM-dd HH:mm:ss": r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z",
}


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_date(value: AsOf) -> Column:
    """A date column from a column, a date, or text such as 2024-01-31 or 20240131."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, str):
        digits = value.replace("-", "")
        value = dt.datetime.strptime(digits, "%Y%m%d").date()
    return F.lit(value)


def as_month(value: AsOf) -> Column:
    """First day of the month that holds the given day, or is given as 2024-01."""
    named = isinstance(value, str) and len(value) == len("2024-01")
    return F.trunc(as_date(f"{value}-01" if named else value), "MM")


def as_timestamp(value: AsOf) -> Column:
    """Midnight at the start of the given day, without a zone."""
    return as_date(value).cast("timestamp_ntz")


def month_key(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def month_year_label(day: Column | str) -> Column:
    return F.date_format(col(day), "MMMM yyyy")


def month_name(day: Column | str) -> Column:
    return F.date_format(col(day), "MMMM")


def iso_day(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyy-MM-dd")


def long_date(day: Column | str) -> Column:
    return F.date_format(col(day), "MMM d, yyyy")


def to_timestamp(text: Column | str, fmt: str | None = None) -> Column:
    """Text to timestamp without a zone; unreadable text becomes null.

    With a format the text is read as a one-field record, the only way to
    parse by format without passing through the session time zone. Text in the
    common form of a format is cast, which gives the same several times faster.
    """
    if fmt is None:
        return col(text).try_cast("timestamp_ntz")
    options = {"timestampNTZFormat": fmt, "sep": "\u0001"}
    stamp = F.from_csv(col(text), "stamp timestamp_ntz", options)["stamp"]
    if fmt not in COMMON_FORMS:
        return stamp
    return F.when(col(text).rlike(COMMON_FORMS[fmt]), col(text).try_cast("timestamp_ntz")).otherwise(stamp)


def days_left_in_month(day: Column | str) -> Column:
    return F.date_diff(F.last_day(col(day)), col(day).cast("date"))


def month_start(day: Column | str) -> Column:
    return F.trunc(col(day), "MM")


def month_end(day: Column | str) -> Column:
    return F.last_day(col(day))


def previous_month_start(day: Column | str) -> Column:
    return F.add_months(month_start(day), -1)


def previous_month_end(day: Column | str) -> Column:
    return F.date_sub(month_start(day), 1)


def _from(day: Column | str, start: Column, months: int) -> Column:
    """A range over the stored column, so the scan can skip other days."""
    return (col(day) >= start) & (col(day) < F.add_months(start, months))


def same_year(day: Column | str, as_of: AsOf) -> Column:
    return _from(day, F.trunc(as_date(as_of), "YEAR"), 12)


def same_month(day: Column | str, as_of: AsOf) -> Column:
    return _from(day, month_start(as_date(as_of)), 1)
