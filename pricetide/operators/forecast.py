"""Rows of the price forecast: what is known before the day of a record, for training and for serving alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.live import DEFAULT_OIL_PRICE
from pricetide.operators.means import LAGS, LONG, oil_features

# Days of the training part, as a share of all days.
TRAIN_SHARE = 0.7
# Fixed value: a prediction within this many euros of the price is a hit.
GOAL = 0.01


def last_before(series: DataFrame, days: DataFrame, day: str = "day_key") -> DataFrame:
    """For every day the values of the last row of the series dated before it.

    Both are small: one row per calendar day.
    """
    values = [name for name in series.columns if name != "date"]
    known = series.select("date", F.struct(*values).alias("known"))
    asked = days.select(F.col(day).alias("date")).where(F.col(day).isNotNull()).distinct().withColumn("asked", F.lit(0))
    both = known.withColumn("asked", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    # On the same date the question comes before the value.
    past = Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("last", F.last("known", ignorenulls=True).over(past)).where("asked = 0")
    return found.select(F.col("date").alias(day), *[F.col("last")[name].alias(name) for name in values])


def history_before(daily: DataFrame, keys: DataFrame, fuel: str = "e5", day: str = "day_key") -> DataFrame:
    """Lags, 7-day average and volatility for every (uuid, day) of `keys`, over days observed before it.

    Days are numbered by the observed days before them, so the day itself is never in a frame. A station has
    one row per day here.
    """
    mean = f"{fuel}_1d_mean"
    observed = daily.where(F.col(mean).isNotNull()).select("uuid", day, mean)
    rows = keys.select("uuid", day).distinct().join(observed, ["uuid", day], "full")
    station = Window.partitionBy("uuid")
    until = station.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_no", F.count(mean).over(until) + 1)
    by_number = station.orderBy("_no")
    week = by_number.rangeBetween(-LONG, -1)
    values = {f"{fuel}_lag_{lag}": F.avg(mean).over(by_number.rangeBetween(-lag, -lag)) for lag in LAGS}
    values[f"{fuel}_7d_avg"] = F.avg(mean).over(week)
    values[f"{fuel}_volatility"] = F.coalesce(F.stddev_samp(mean).over(week), F.lit(0.0))
    return numbered.withColumns(values).select("uuid", day, *values)


def market_means(daily: DataFrame, fuel: str = "e5", day: str = "day_key") -> DataFrame:
    """Mean of all stations' daily means, per date."""
    return daily.groupBy(F.col(day).alias("date")).agg(F.avg(f"{fuel}_1d_mean").alias("market")).where("market IS NOT NULL")


def filled(history: DataFrame, fallback: Column, fuel: str = "e5") -> DataFrame:
    """Lags and average that a station lacks become its last known daily mean, and else `fallback`."""
    last = f"{fuel}_lag_1"
    names = [last, *[f"{fuel}_lag_{lag}" for lag in LAGS if lag != 1], f"{fuel}_7d_avg"]
    return history.withColumns({name: F.coalesce(name, last, fallback) for name in names}).withColumn(
        f"{fuel}_volatility", F.coalesce(f"{fuel}_volatility", F.lit(0.0))
    )


def forecast_rows(records: DataFrame, daily: DataFrame, oil: DataFrame, fuel: str = "e5", day: str = "day_key") -> DataFrame:
    """All records with a price, each with features from days before its own.

    Oil is the last close before the day, so weekends and the day's own close make no difference. A station
    without earlier days takes the market's mean of the last day before; the market's first day has 0. Oil
    before the series begins is the price that live forecasts assume.
    """
    priced = records.where(F.col(fuel).isNotNull())
    days = priced.select(day)
    context = last_before(market_means(daily, fuel, day), days, day).join(
        last_before(oil_features(oil), days, day), day
    )
    history = history_before(daily, priced, fuel, day)
    # The calendar has one row per day.
    joined = priced.join(history, ["uuid", day], "left").join(F.broadcast(context), day, "left")
    oil_values = {name: F.coalesce(name, F.lit(DEFAULT_OIL_PRICE)) for name in ("oil_price", "oil_7d_avg")}
    return filled(joined, F.coalesce("market", F.lit(0.0)), fuel).withColumns(oil_values).drop("market")


def with_time_split(rows: DataFrame, share: float = TRAIN_SHARE, day: str = "day_key") -> DataFrame:
    """`split`: the first `share` of the days trains, the later days test. One row per day is broadcast."""
    days = rows.select(day).where(F.col(day).isNotNull()).distinct()
    everything = Window.partitionBy(F.lit(0))
    number = F.row_number().over(everything.orderBy(day))
    border = F.ceil(F.count("*").over(everything) * F.lit(share))
    calendar = days.select(day, F.when(number <= border, "train").otherwise("test").alias("split"))
    return rows.join(F.broadcast(calendar), day)


def hit_share(actual: str = "actual", predicted: str = "predicted", goal: float = GOAL) -> Column:
    """Share of the predictions that miss by at most `goal` euros, as an aggregate."""
    return F.avg((F.abs(F.col(actual) - F.col(predicted)) <= goal).cast("double"))
