"""Dump sections, COPY rows, files, JSON lists, writers."""

from __future__ import annotations

import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from pricetide.operators import means as mn
from pricetide.operators.frames import drop_incomplete, drop_strict
from pricetide.schemas import PRICE_SECTION, STATION_FILE_COLUMNS, STATION_SECTION
from pricetide.sources import dump, rows, tables, writers


def station_line(key: str, **fields: str) -> str:
    return "\t".join({"id": key, "lat": "52.5", "lng": "13.4", **fields}.get(c, "\\N") for c in STATION_FILE_COLUMNS)


def price_line(key: int, station: str, moment: str = "2025-04-21 10:00:00+02") -> str:
    return f"{key}\t{station}\t1799\t-1\t1650\t{moment}\t3"


DUMP = [
    "-- dump",
    "COPY public.gas_station (id, version) FROM stdin;",
    station_line("s1", name="NA", brand=" Aral", post_code="01067"),
    station_line("s2", name='"x', brand="\\N"),
    "\\.",
    "",
    "COPY public.gas_station_information_history (id, uuid) FROM stdin;",
    *[price_line(i, f"s{i % 2 + 1}") for i in range(300)],
    "900\ts1\t1",
    price_line(901, "s1", "2025-04-21 10:00:00.5+02"),
    price_line(902, "s1")[: -len("\t3")],
    "\\.",
    "COPY public.other (id) FROM stdin;",
    price_line(999, "s9"),
    "\\.",
]


@pytest.mark.parametrize("packed", [False, True])
def test_dump_to_rows(spark, tmp_path, packed):
    path = tmp_path / ("d.txt.gz" if packed else "d.txt")
    data = "\n".join(DUMP).encode()
    path.write_bytes(gzip.compress(data) if packed else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # many splits
    try:
        lines = dump.land_dump(spark, str(path), str(tmp_path / "landed"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    prices = dump.parse_price_lines(dump.copy_section(lines, PRICE_SECTION))
    good = rows.accepted(prices)
    assert good.count() == 301
    assert {r.id for r in good.select("id").collect()} == {*range(300), 902}
    assert good.where("id = 902").first().change is None
    assert good.first().date == datetime(2025, 4, 21, 8)
    reasons = {r.line.split("\t")[0]: r.reject for r in rows.rejected(prices).collect()}
    assert reasons == {"900": "too few fields", "901": "date not readable"}

    stations = rows.accepted(dump.parse_station_lines(dump.copy_section(lines, STATION_SECTION)))
    found = {r.id: r for r in stations.collect()}
    assert found.keys() == {"s1", "s2"}
    assert (found["s1"].name, found["s1"].post_code, found["s1"].lat) == ("NA", "01067", 52.5)
    assert (found["s2"].name, found["s2"].brand, found["s2"].post_code) == ('"x', None, None)


def test_missing_sections(spark):
    lines = spark.createDataFrame([(0, "COPY public.gas_station (id) FROM stdin;"), (1, "s1")], "line_no long, line string")
    with pytest.raises(ValueError, match="no COPY marker"):
        dump.copy_section(lines, PRICE_SECTION)
    with pytest.raises(ValueError, match="no end marker"):
        dump.copy_section(lines, STATION_SECTION)


def test_trailing_fields_vanish(spark):
    """A line is stripped before it is split: five fields and blanks are too few."""
    lines = spark.createDataFrame([("1\ts\t1\t1\t1\t\t",), (price_line(2, "s") + "\t",)], "line string")
    rejects = {r.id: r.reject for r in dump.parse_price_lines(lines).select("id", "reject").collect()}
    assert rejects == {1: "too few fields", 2: None}


def test_price_file_round_trip(spark, tmp_path):
    made = spark.createDataFrame(
        [(1, "a", 1, None, 3, "2025-04-21 10:00:00+02", 1), (2, None, 1, 2, 3, "x", None)],
        "id long, uuid string, e5 int, e10 int, diesel int, date string, change int",
    )
    writers.write_tsv(made, str(tmp_path / "p"))
    back = tables.read_prices(spark, str(tmp_path / "p"))
    assert sorted(rows.accepted(back).collect()) == sorted(made.collect(), key=lambda r: r.id)


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    header = "id\tuuid\te5\te10\tdiesel\tdate\tchange"
    lines = ["1\ta\t1\t1\t1\td\t1", "2\tb\tx\t1\t1\td\t1", "3\tc\t1", "4\td\t1\t1\t1\td\t1\t9"]
    (tmp_path / "p.tsv").write_text("\n".join([header, *lines]))
    loaded = tables.read_prices(spark, str(tmp_path / "p.tsv"))
    assert [r.id for r in rows.accepted(loaded).select("id").collect()] == [1]
    assert rows.accepted(loaded).count() == 1
    reasons = {r.line[0]: r.reject for r in rows.rejected(loaded).collect()}
    assert reasons == {"2": "e5 not readable", "3": "too few fields", "4": "too many fields"}


def test_oil_file(spark, tmp_path):
    series = spark.createDataFrame([(date(2025, 4, d), float(d)) for d in (3, 1, 2)], "date date, close double")
    writers.write_csv(series, str(tmp_path / "oil"))
    assert sorted(r.close for r in tables.read_oil(spark, str(tmp_path / "oil")).collect()) == [2.0, 3.0]
    assert tables.read_oil(spark, str(tmp_path / "oil"), skip_first=False).count() == 3
    doubled = series.unionAll(series)
    assert mn.one_close_per_day(doubled).count() == 3


def test_json_stations(spark):
    inner = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("deep", T.StructType([T.StructField("z", T.IntegerType())]))])
    station = T.StructType([T.StructField("id", T.StringType()), T.StructField("e5", T.DoubleType()), T.StructField("p", inner)])
    text = '{"stations":[{"id":"a","e5":1.7,"p":{"k":1,"deep":{"z":2}}},{"id":"b","p":{"k":2}}]}'
    flat = tables.flatten_stations(spark.createDataFrame([(text,), ("no json",)], "text string"), "text", station)
    assert flat.columns == ["id", "e5", "p.k", "p.deep"]  # one level only
    assert [r.id for r in drop_incomplete(flat).collect()] == ["a"]


def test_strict_drop(spark):
    frame = spark.range(1).selectExpr("id", "1 AS a")
    assert drop_strict(frame, "a").columns == ["id"]
    with pytest.raises(ValueError):
        drop_strict(frame, "a", "b")


def test_append_and_replace(spark, tmp_path):
    for _ in range(2):
        writers.append_run(spark.range(1), str(tmp_path / "runs"))
        writers.write_table(spark.range(4).selectExpr("id", "id % 2 AS day"), str(tmp_path / "t"), ["day"])
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert (tmp_path / "t" / "day=1").is_dir()
