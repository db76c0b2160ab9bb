"""Hourly prices, cheapest hours and price patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hourly_last(prices: DataFrame, price: str) -> DataFrame:
    """Last known price per station and hour; combines on the map side, so no station is a hot group."""
    known = prices.where(F.col("uuid").isNotNull() & F.col(price).isNotNull())
    last = F.max_by(price, F.struct("date", "id"))
    return known.groupBy("uuid", F.date_trunc("hour", "date").cast("timestamp_ntz").alias("hour_start")).agg(
        last.alias(price)
    )


def hourly_grid(prices: DataFrame, price: str = "e5") -> DataFrame:
    """One price per station and hour, from the station's first hour to its last.

    An hour without a record carries the last price forward. Each known hour is stretched to the hour
    before the station's next known one, so no join with a full grid is needed.
    """
    hours = _hourly_last(prices, price)
    following = F.lead("hour_start").over(Window.partitionBy("uuid").orderBy("hour_start"))
    until = F.coalesce(F.col("_next") - F.expr("INTERVAL 1 HOUR"), F.col("hour_start"))
    span = F.sequence("hour_start", until, F.expr("INTERVAL 1 HOUR"))
    return hours.withColumn("_next", following).select("uuid", F.explode(span).alias("hour_start"), price)


def cheapest_hour(grid: DataFrame, price: str = "e5") -> DataFrame:
    """Cheapest hour of every station and day, the earliest one among equals."""
    best = F.min(F.struct(F.col(price), F.col("hour_start")))
    return (
        grid.groupBy("uuid", F.to_date("hour_start").alias("day_key"))
        .agg(best.alias("_best"))
        .select("uuid", "day_key", F.hour("_best.hour_start").alias("hour"), F.col(f"_best.{price}").alias(price))
    )


def price_patterns(labelled: DataFrame, price: str = "diesel") -> DataFrame:
    """Mean price and change rate by brand, weekday and hour."""
    return labelled.groupBy("brand", "weekday", "hour").agg(
        F.count("*").alias("records"),
        F.avg(price).alias("mean_price"),
        F.avg("price_will_change").alias("change_rate"),
    )
