"""Features of a live station list: what is known now, filled up from the station's history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import features as fx
from pricetide.operators.means import LAGS, LONG

# Fixed value: oil price assumed where no series is given.
DEFAULT_OIL_PRICE = 70.0


def history_features(daily: DataFrame, fuel: str = "e5", day: str = "day_key") -> DataFrame:
    """One row per station: lags, 7-day average and volatility as of the day after its last known day."""
    mean, back = F.col(f"{fuel}_1d_mean"), F.col("_back")
    newest_first = Window.partitionBy("uuid").orderBy(F.col(day).desc())
    known = daily.where(mean.isNotNull()).withColumn("_back", F.row_number().over(newest_first))
    return (
        known.where(back <= LONG)
        .groupBy("uuid")
        .agg(
            *[F.max(F.when(back == lag, mean)).alias(f"{fuel}_lag_{lag}") for lag in LAGS],
            F.avg(mean).alias(f"{fuel}_7d_avg"),
            F.stddev_samp(mean).alias(f"{fuel}_volatility"),
        )
    )


def live_features(
    live: DataFrame,
    history: DataFrame,
    moment: datetime,
    fuel: str = "e5",
    oil_price: float = DEFAULT_OIL_PRICE,
    oil_average: float | None = None,
    last_known: bool = False,
) -> DataFrame:
    """Forecast features of a live list (`id` and the fuel's price) at `moment`.

    A station without enough history takes its current price for lags and average, and volatility 0. With
    `last_known` it takes the mean of its last known day where there is one, as forecast rows do.
    """
    price = F.col(fuel)
    past = history.withColumnRenamed("uuid", "_station")
    filled = [*[f"{fuel}_lag_{lag}" for lag in LAGS], f"{fuel}_7d_avg"]
    last = [F.col(filled[0])] if last_known else []
    clock = fx.time_features(fx.moment(moment))
    return (
        live.join(past, F.col("id") == F.col("_station"), "left")
        .drop("_station")
        .withColumns({name: F.coalesce(name, *last, price) for name in filled})
        .withColumn(f"{fuel}_volatility", F.coalesce(f"{fuel}_volatility", F.lit(0.0)))
        .withColumns({name: clock[name] for name in ("hour", "hour_sin", "hour_cos")})
        .withColumn("oil_price", F.lit(float(oil_price)))
        .withColumn("oil_7d_avg", F.lit(float(oil_price if oil_average is None else oil_average)))
    )
