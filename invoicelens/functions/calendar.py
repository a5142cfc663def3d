"""Dates, labels and parts of the day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

LOCAL_ZONE = "America/Argentina/Buenos_Aires"


def as_day(value: str | dt.date | None) -> Column:
    """A day given by the caller; today when none is given."""
    if value is None:
        return F.current_date()
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def day_label(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def weekday_name(day: Column) -> Column:
    """English day name padded with blanks to nine characters."""
    return F.rpad(F.date_format(day, "EEEE"), 9, " ")


def weekday_number(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def day_part(utc_time: Column, zone: str = LOCAL_ZONE) -> Column:
    """Greeting period by local hour: 5-13 morning, 14-19 afternoon, night otherwise."""
    hour = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time))
    return (
        F.when((hour >= 5) & (hour < 14), "morning")
        .when((hour >= 14) & (hour < 20), "afternoon")
        .otherwise("night")
    )
