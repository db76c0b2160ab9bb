"""Column contracts of the landed files. Nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the price-history and station extracts.
PRICE_FILE_COLUMNS = ["id", "uuid", "e5", "e10", "diesel", "date", "change"]
STATION_FILE_COLUMNS = [
    "id", "version", "version_time", "name", "brand", "street", "house_number", "post_code", "place",
    "public_holiday_identifier", "lat", "lng", "price_in_import", "price_changed", "open_ts", "ot_json",
    "station_in_import", "first_active",
]

# Table names of the two COPY sections in a database text dump.
PRICE_SECTION = "gas_station_information_history"
STATION_SECTION = "gas_station"

# Fuels, and the station columns that no feature uses.
FUELS = ["e5", "e10", "diesel"]
UNUSED_STATION_COLUMNS = [
    "version", "version_time", "name", "street", "house_number", "place", "price_in_import",
    "price_changed", "open_ts", "ot_json", "station_in_import", "first_active",
]

_PRICE_TYPES = {"id": T.LongType(), "uuid": T.StringType(), "date": T.StringType()}
_STATION_TYPES = {"lat": T.DoubleType(), "lng": T.DoubleType()}


def _fields(names, types, default):
    return [T.StructField(name, types.get(name, default)) for name in names]


PRICE_SCHEMA = T.StructType(_fields(PRICE_FILE_COLUMNS, _PRICE_TYPES, T.IntegerType()))
STATION_SCHEMA = T.StructType(_fields(STATION_FILE_COLUMNS, _STATION_TYPES, T.StringType()))
OIL_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())])
# Fields used of a station in a live list.
LIVE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("e5", T.DoubleType())])
