"""Daily means, rolling means over observed days, lags, and the oil series."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.features import day_key
from pricetide.schemas import FUELS

# Lowest plausible price in euros (exclusive), rolling lengths in days, lags in days.
PLAUSIBLE = 1
SHORT, LONG = 3, 7
LAGS = [1, 3, 7]


def with_day_key(prices: DataFrame, mode: str = "date", name: str = "day_key") -> DataFrame:
    return prices.withColumn(name, day_key(F.col("date"), mode))


def _plausible(fuel: str) -> Column:
    return F.when(F.col(fuel) > PLAUSIBLE, F.col(fuel))


def daily_means(prices: DataFrame, fuels: list[str] = FUELS, day: str = "day_key") -> DataFrame:
    """Mean price per station and day for every fuel, over plausible prices only.

    One aggregate for all fuels. It combines on the map side, so a busy station is reduced to one row
    per day and task before the shuffle.
    """
    observed = reduce(or_, [F.col(fuel) > PLAUSIBLE for fuel in fuels])
    return (
        prices.where(observed & F.col("uuid").isNotNull())
        .groupBy("uuid", day)
        .agg(*[F.avg(_plausible(fuel)).alias(f"{fuel}_1d_mean") for fuel in fuels])
    )


def _day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def rolling_means(
    daily: DataFrame,
    fuels: list[str] = FUELS,
    day: str = "day_key",
    frame: str = "observed",
    narrow_short: bool = False,
) -> DataFrame:
    """Rolling means of the daily means, on days when the fuel was observed.

    `frame="observed"` averages the last 3 / 7 days on which *this* fuel was observed: days are
    numbered per fuel by their running count, and the frame is a range over that number.
    `frame="calendar"` averages the last 3 / 7 calendar days (needs date keys).
    All frames share one exchange by station; a station has one row per day here.
    `narrow_short` keeps the short mean as a 4-byte float.
    """
    station = Window.partitionBy("uuid")
    if frame == "observed":
        numbers = {fuel: F.count(f"{fuel}_1d_mean").over(station.orderBy(day)) for fuel in fuels}
    elif frame == "calendar":
        numbers = {fuel: _day_number(day) for fuel in fuels}
    else:
        raise ValueError(f"unknown frame: {frame}")
    numbered = daily.withColumns({f"_{fuel}_no": number for fuel, number in numbers.items()})

    rolled = {}
    for fuel in fuels:
        mean, days = F.col(f"{fuel}_1d_mean"), station.orderBy(f"_{fuel}_no")
        for length in (SHORT, LONG):
            average = F.avg(mean).over(days.rangeBetween(1 - length, 0))
            value = F.when(mean.isNotNull(), average)
            narrow = narrow_short and length == SHORT
            rolled[f"{fuel}_{length}d_mean"] = value.cast("float") if narrow else value
    names = [f"{fuel}_{length}d_mean" for fuel in fuels for length in (1, SHORT, LONG)]
    return numbered.withColumns(rolled).select("uuid", day, *names)


def attach_means(prices: DataFrame, means: DataFrame, day: str = "day_key") -> DataFrame:
    """One left join for the means of all fuels.

    A busy station-day on the price side is split by AQE's skew join; the means have one row per key.
    """
    return prices.join(means, ["uuid", day], "left")


def skip_first_day(oil: DataFrame) -> DataFrame:
    """Oil series without its first day. The series has one row per day, so the window is small."""
    return (
        oil.withColumn("_no", F.row_number().over(Window.orderBy("date"))).where(F.col("_no") > 1).drop("_no")
    )


def one_close_per_day(oil: DataFrame) -> DataFrame:
    """One row per calendar date: repeated downloads of a day collapse."""
    return oil.groupBy("date").agg(F.max("close").alias("close"))


def oil_features(oil: DataFrame) -> DataFrame:
    """Oil close and its mean over the last 7 trading days, per date."""
    last_days = Window.orderBy("date").rowsBetween(1 - LONG, 0)
    return one_close_per_day(oil).select(
        "date", F.col("close").alias("oil_price"), F.avg("close").over(last_days).alias("oil_7d_avg")
    )


def attach_oil(prices: DataFrame, oil: DataFrame, day: Column | None = None) -> DataFrame:
    """Left join of oil values on the calendar date; days without trade stay NULL.

    The series is held to one row per date first, so the broadcast is bounded by the calendar.
    """
    values = [F.max(name).alias(name) for name in oil.columns if name != "date"]
    series = oil.groupBy(F.col("date").alias("_oil_date")).agg(*values)
    day = F.to_date("date") if day is None else day
    return prices.join(F.broadcast(series), day == F.col("_oil_date"), "left").drop("_oil_date")


def lag_features(daily: DataFrame, fuel: str = "e5", day: str = "day_key") -> DataFrame:
    """Lags, 7-day average and volatility of a fuel's daily mean, over observed days.

    Volatility is 0 while a single day is known.
    """
    mean = f"{fuel}_1d_mean"
    days = Window.partitionBy("uuid").orderBy(day)
    last_days = days.rowsBetween(1 - LONG, 0)
    return daily.where(F.col(mean).isNotNull()).select(
        "uuid",
        day,
        mean,
        *[F.lag(mean, lag).over(days).alias(f"{fuel}_lag_{lag}") for lag in LAGS],
        F.avg(mean).over(last_days).alias(f"{fuel}_7d_avg"),
        F.coalesce(F.stddev_samp(mean).over(last_days), F.lit(0.0)).alias(f"{fuel}_volatility"),
    )
