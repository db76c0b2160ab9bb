"""Price records: cleaning, station join, time features, next price and change label."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import features as fx
from pricetide.functions.text import null_marker, parse_utc, to_int
from pricetide.operators.frames import drop_strict, placed, written
from pricetide.schemas import FUELS, UNUSED_STATION_COLUMNS

# A station with more records than this is not one window partition.
STATION_ROWS = 2_000_000

# Fixed value: days of price history that are kept.
HISTORY_DAYS = 60


def is_recent(prices: DataFrame, days: int = HISTORY_DAYS, as_of: datetime | Column | None = None) -> Column:
    """Whether a record is at most `days` days older than `as_of` (default now). Later records pass as well.

    Only the literal side is cast, so the comparison reaches the Parquet scan.
    """
    moment = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else fx.moment(as_of)
    cutoff = moment.cast(prices.schema["date"].dataType) - F.make_dt_interval(days=F.lit(days))
    return F.col("date") >= cutoff


def recent(prices: DataFrame, days: int = HISTORY_DAYS, as_of: datetime | Column | None = None) -> DataFrame:
    return prices.where(is_recent(prices, days, as_of))


def normalise_prices(prices: DataFrame) -> DataFrame:
    """Raw integer prices to euros."""
    return prices.withColumns({fuel: fx.euros(F.col(fuel)) for fuel in FUELS})


def parse_dates(prices: DataFrame) -> DataFrame:
    """Text dates of a price file to UTC timestamps."""
    return prices.withColumn("date", parse_utc(F.col("date")))


def latest_stations(stations: DataFrame) -> DataFrame:
    """One row per station id: the one with the newest `version_time`, and of these the highest version.

    Versions are compared as numbers where they are numbers. `max_by` combines on the map side, so copies of
    one station never meet in one task.
    """
    when = F.col("version_time").cast("string")
    age = F.struct(
        F.try_to_timestamp(when), when,
        F.col("version").try_cast("long"), "version",
    )
    newest = F.max_by(F.struct(*stations.columns), age)
    return stations.groupBy("id").agg(newest.alias("_row")).select("_row.*")


def tidy_stations(stations: DataFrame) -> DataFrame:
    """Null markers of the post code resolved, the number offered next to the text."""
    code = null_marker(F.col("post_code"))
    return stations.withColumns({"post_code": code, "post_code_int": to_int(code)})


def enrich(prices: DataFrame, stations: DataFrame) -> DataFrame:
    """Left join of station attributes by station id.

    No broadcast hint: the station table is broadcast when its size is under Spark's threshold, and
    beyond it AQE splits the partitions of a busy station. Null ids match nothing.
    """
    master = stations.drop(*UNUSED_STATION_COLUMNS).withColumnRenamed("id", "_station")
    return prices.join(master, F.col("uuid") == F.col("_station"), "left").drop("_station")


def with_time_features(prices: DataFrame, zone: str | None = None) -> DataFrame:
    """hour, minute, month, day, weekday and their cycles; in UTC unless a `zone` is given."""
    date = F.col("date") if zone is None else fx.local_time(F.col("date"), zone)
    return prices.withColumns(fx.time_features(date))


def _in_order() -> list[Column]:
    return [F.col("date").asc_nulls_last(), F.col("id").asc_nulls_last()]


def _next_of_ordinary(records: DataFrame, record: Column) -> DataFrame:
    """A station is one window partition."""
    return records.withColumn("_next", F.lead(record).over(Window.partitionBy("uuid").orderBy(*_in_order())))


def _next_of_busy(records: DataFrame, record: Column) -> DataFrame:
    """Records are put in global order and cut into even parts, wherever a station begins or ends.

    The next record is found inside the part; the last record of a part takes the first record of the
    next part. Those are one row per part, which bounds the broadcast.
    """
    rows = placed(records, ["uuid", *_in_order()])
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.agg(F.max("_part")).first()[0] + 1
    rows = rows.repartition(max(session, parts), "_part")
    follower = F.struct("uuid", record.alias("record"))
    heads = rows.where(F.col("_pos") == 0).select("_part", follower.alias("_head"))
    next_heads = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_next_head"))
    within = F.lead(follower).over(Window.partitionBy("_part").orderBy("_pos"))
    following = F.coalesce("_follower", "_next_head")
    return (
        rows.withColumn("_follower", within)
        .join(F.broadcast(next_heads), "_part")
        .select(*records.columns, F.when(following["uuid"] == F.col("uuid"), following["record"]).alias("_next"))
    )


def with_next(prices: DataFrame, names: dict[str, str], station_rows: int = STATION_ROWS) -> DataFrame:
    """Values of the station's next record, by date and then id; `names` maps columns to new columns.

    Any one station may hold a large share of all records. Records are counted per station first: one
    scan of one column, combined on the map side. Stations with more than `station_rows` records, of
    which there are at most (all records / station_rows), take a path without a partition per station.
    Records without a station have no next record and are not shuffled.
    """
    record = F.struct(*names)
    known = prices.where(F.col("uuid").isNotNull())
    counts = known.groupBy("uuid").agg(F.count("*").alias("_n"))
    busy = written(counts.where(F.col("_n") > station_rows).select("uuid"), "busy-stations")
    if busy.isEmpty():
        followed = _next_of_ordinary(known, record)
    else:
        ordinary = known.join(F.broadcast(busy), "uuid", "left_anti")
        crowded = known.join(F.broadcast(busy), "uuid", "left_semi")
        followed = _next_of_ordinary(ordinary, record).unionByName(_next_of_busy(crowded, record))
    alone = prices.where(F.col("uuid").isNull()).withColumn("_next", F.lit(None).cast(followed.schema["_next"].dataType))
    new = [F.col("_next")[column].alias(name) for column, name in names.items()]
    return followed.unionByName(alone).select(*prices.columns, *new)


def with_next_price(
    prices: DataFrame, price: str = "diesel", name: str = "diesel_shift", station_rows: int = STATION_ROWS
) -> DataFrame:
    """Price of the station's next record; NULL for its last record and for records without a station."""
    return with_next(prices, {price: name}, station_rows)


def with_change_label(
    prices: DataFrame, price: str = "diesel", following: str = "diesel_shift", name: str = "price_will_change"
) -> DataFrame:
    return prices.withColumn(name, fx.change_label(F.col(price), F.col(following)))


# Columns the enriched table does not keep, and those the final table does not keep.
DROPPED_AFTER_LABEL = ["change", "public_holiday_identifier", "weekday", "post_code", "lat", "lng"]
DROPPED_AT_END = ["id", "date"]


def price_features(prices: DataFrame, stations: DataFrame) -> DataFrame:
    """Enriched price table: station brand, time features, prices in euros, next price and label.

    The next price is found before the station join, so the wide row is not part of that shuffle.
    """
    return (
        prices.transform(normalise_prices)
        .transform(with_next_price)
        .transform(with_change_label)
        .transform(enrich, stations)
        .transform(with_time_features)
        .drop(*DROPPED_AFTER_LABEL, "post_code_int", "hour_cos")
    )


def final_table(features: DataFrame) -> DataFrame:
    """Feature table without record id and date."""
    return drop_strict(features, *DROPPED_AT_END)


# Order inside the files of the final table; the first two columns are those that it is stored by.
FINAL_ORDER = ["month", "day", "uuid"]
