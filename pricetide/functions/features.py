"""Scalar features of a price record."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw prices are thousandths of a euro; hours per day; days per week.
PRICE_SCALE = 1000
HOURS = 24
WEEKDAYS = 7


def moment(value: datetime) -> Column:
    """A moment as UTC clock time, whatever the zones of machine and session are; aware values are converted."""
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def euros(raw: Column) -> Column:
    """Raw integer price in euros; a negative price is the marker for "missing"."""
    return F.when(raw >= 0, raw / PRICE_SCALE)


def cycle_sin(value: Column, period: int) -> Column:
    return F.sin(F.lit(2 * math.pi) * value / period)


def cycle_cos(value: Column, period: int) -> Column:
    return F.cos(F.lit(2 * math.pi) * value / period)


def time_features(date: Column) -> dict[str, Column]:
    """Calendar fields of a UTC timestamp; Monday is weekday 0."""
    hour, weekday = F.hour(date), F.weekday(date)
    return {
        "hour": hour,
        "minute": F.minute(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "weekday": weekday,
        "hour_sin": cycle_sin(hour, HOURS),
        "hour_cos": cycle_cos(hour, HOURS),
        "weekday_sin": cycle_sin(weekday, WEEKDAYS),
    }


def local_time(date: Column, zone: str) -> Column:
    """UTC wall clock read as the wall clock of `zone`, for features in local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), date)


def change_label(price: Column, following: Column) -> Column:
    """1 where the next price differs; a price missing on either side counts as a change."""
    return F.coalesce(price != following, F.lit(True)).cast("int")


def mmdd(date: Column) -> Column:
    """Day key without the year, as month * 100 + day."""
    return F.month(date) * 100 + F.dayofmonth(date)


def day_key(date: Column, mode: str = "date") -> Column:
    """Key of a record's day: the calendar date, or `mmdd` where results must ignore the year."""
    if mode == "date":
        return F.to_date(date)
    if mode == "mmdd":
        return mmdd(date)
    raise ValueError(f"unknown day key: {mode}")


def over_threshold(probability: Column, threshold: float) -> Column:
    """Class at a threshold; a probability equal to the threshold is class 0."""
    return (probability > threshold).cast("int")
