"""Price-event views derived from the general test tables.

Users stand for stations, customers for the station master, event values for price levels. The SQL is
the same for Spark and the checking engine unless a second text is given; `{name}` is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The definitions of the views.
PRICES_RAW = """
SELECT event_id AS id, concat('st-', lpad(cast(user_id AS string), 6, '0')) AS uuid,
 CASE WHEN event_id % 83 = 0 THEN -1 ELSE 1300 + 100 * cast(floor(value / 25) AS int) + cast(event_id % 3 AS int) * 10 END AS e5,
 CASE WHEN event_id % 89 = 0 THEN -1 ELSE 1240 + 100 * cast(floor(value / 25) AS int) END AS e10,
 CASE WHEN event_id % 97 = 0 THEN -1 WHEN event_id % 53 = 0 THEN 900 ELSE 1200 + 100 * cast(floor(value / 25) AS int) END AS diesel,
 ts AS date, cast(event_id % 8 AS int) AS change FROM {events}
"""

STATIONS = """
SELECT concat('st-', lpad(cast(c_custkey AS string), 6, '0')) AS id, c_name AS name,
 CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN concat(chr(9), lower(c_mktsegment), ' ') ELSE concat(' ', lower(c_mktsegment)) END AS brand,
 CASE WHEN c_custkey % 10 = 0 THEN concat(chr(92), 'N') ELSE lpad(cast(c_custkey AS string), 5, '0') END AS post_code
 FROM {customer}
"""

SCORES = """
SELECT doc_id AS id, quality AS y_true, cast(n_chars % 1000 AS double) / 1000 AS y_prob FROM {labels} JOIN {documents} USING (doc_id)
"""

OIL_DAILY = """
SELECT cast(ts AS date) AS date, round(avg(value), 4) AS close FROM {events} WHERE event_type = 'purchase' AND weekday(ts) < 5 GROUP BY cast(ts AS date)
"""

OIL_DAILY_CHECK = """
SELECT cast(ts AS date) AS date, round(avg(value), 4) AS close FROM {events} WHERE event_type = 'purchase' AND isodow(ts) <= 5 GROUP BY cast(ts AS date)
"""

OIL_TICKS = """
SELECT concat('st-', lpad(cast(user_id AS string), 6, '0')) AS uuid, ts AS date, value AS close FROM {events} WHERE event_type = 'purchase'
"""

COPY_LINES = """
SELECT id, concat_ws(chr(9), cast(id AS string), uuid, cast(e5 AS string), cast(e10 AS string), cast(diesel AS string),
 CASE WHEN id % 50 = 0 THEN 'bad' ELSE concat(date_format(date, 'yyyy-MM-dd HH:mm:ss'), CASE WHEN id % 2 = 1 THEN '+01' ELSE '+00' END) END, cast(change AS string)) AS line FROM {prices_raw}
"""

COPY_LINES_CHECK = """
SELECT id, concat_ws(chr(9), cast(id AS string), uuid, cast(e5 AS string), cast(e10 AS string), cast(diesel AS string),
 CASE WHEN id % 50 = 0 THEN 'bad' ELSE concat(strftime(date, '%Y-%m-%d %H:%M:%S'), CASE WHEN id % 2 = 1 THEN '+01' ELSE '+00' END) END, cast(change AS string)) AS line FROM {prices_raw}
"""

DUMP_LINES = """
SELECT 0 AS line_no, 'COPY public.gas_station (id, name, brand, post_code) FROM stdin;' AS line
 UNION ALL SELECT 1 + cast(substr(id, 4) AS bigint), concat_ws(chr(9), id, name, coalesce(trim(replace(brand, chr(9), ' ')), concat(chr(92), 'N')), post_code) FROM {stations}
 UNION ALL SELECT 10000000, concat(chr(92), '.')
 UNION ALL SELECT 20000000, 'COPY public.gas_station_information_history (id, uuid, e5, e10, diesel, date, change) FROM stdin;'
 UNION ALL SELECT 20000001 + id, line FROM {copy_lines}
 UNION ALL SELECT 90000000, concat(chr(92), '.')
"""


class StandIns:
    """The views as Spark DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table's file as a stream."""
        source = self.spark.readStream.schema(self.table(name).schema).option("pathGlobFilter", f"{name}.parquet")
        return source.parquet(self.sf_dir)

    def _view(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    def prices_from(self, events: DataFrame) -> DataFrame:
        return self._view(PRICES_RAW, events=events)

    @property
    def prices_raw(self) -> DataFrame:
        return self.prices_from(self.table("events"))

    @property
    def stations(self) -> DataFrame:
        return self._view(STATIONS, customer=self.table("customer"))

    @property
    def scores(self) -> DataFrame:
        return self._view(SCORES, labels=self.table("labels"), documents=self.table("documents"))

    @property
    def oil_daily(self) -> DataFrame:
        return self._view(OIL_DAILY, events=self.table("events"))

    @property
    def oil_ticks(self) -> DataFrame:
        return self._view(OIL_TICKS, events=self.table("events"))

    @property
    def copy_lines(self) -> DataFrame:
        return self._view(COPY_LINES, prices_raw=self.prices_raw)

    @property
    def dump_lines(self) -> DataFrame:
        return self._view(DUMP_LINES, stations=self.stations, copy_lines=self.copy_lines)
