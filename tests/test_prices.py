"""Station join, next price, labels, feature table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from pricetide.operators import prices as pr
from pricetide.operators.frames import placed

SCHEMA = "id long, uuid string, date timestamp_ntz, diesel double"


def following(frame, **limits):
    return {r.id: r.diesel_shift for r in pr.with_next_price(frame, **limits).collect()}


def test_next_price_and_label(make):
    rows = [
        (1, "a", "2025-04-01 10:00", 1.0),
        (2, "a", "2025-04-01 11:00", 1.0),
        (3, "b", "2025-04-01 10:00", None),
    ]
    labelled = pr.with_change_label(pr.with_next_price(make(rows, SCHEMA)))
    assert {r.id: (r.diesel_shift, r.price_will_change) for r in labelled.collect()} == {
        1: (1.0, 0),
        2: (None, 1),
        3: (None, 1),
    }


def test_records_without_station_have_no_next(make):
    rows = [(1, None, "2025-04-01 10:00", 2.0), (2, None, "2025-04-01 11:00", 3.0)]
    for limits in ({}, {"station_rows": 0}):
        assert following(make(rows, SCHEMA), **limits) == {1: None, 2: None}


def test_equal_dates_go_by_id_and_undated_come_last(make):
    rows = [
        (2, "a", "2025-04-01 10:00", 2.0),
        (1, "a", "2025-04-01 10:00", 1.0),
        (4, "a", None, 4.0),
        (3, "a", None, 3.0),
    ]
    for limits in ({}, {"station_rows": 0}):
        assert following(make(rows, SCHEMA), **limits) == {1: 2.0, 2: 3.0, 3: 4.0, 4: None}


def by_hand(rows):
    expected, stations = {}, {}
    for row in rows:
        expected[row[0]] = None
        if row[1] is not None:
            stations.setdefault(row[1], []).append(row)
    for records in stations.values():
        records.sort(key=lambda r: (r[2] is None, r[2] or "", r[0]))
        expected.update({a[0]: b[3] for a, b in zip(records, records[1:])})
    return expected


@pytest.mark.parametrize("limits", [{}, {"station_rows": 40}, {"station_rows": 0}])
def test_busy_stations_against_brute_force(make, limits, monkeypatch):
    """One station holds a third of the rows, in bursts and at the same moments, with missing prices."""
    monkeypatch.setattr(pr, "placed", lambda df, order: placed(df, order, most=50))  # a dozen parts
    rng = random.Random(5)
    start, rows = datetime(2025, 4, 1), []
    for key in range(600):
        station = "hot" if rng.random() < 0.34 else rng.choice([None, *"abcdefgh"])
        seconds = int(rng.choice([0, 60, 61, 3600]) + rng.random() ** 6 * 900_000)
        moment = None if rng.random() < 0.03 else (start + timedelta(seconds=seconds)).isoformat(sep=" ")
        rows.append((key, station, moment, rng.choice([None, 1.5, 1.6, 1.7])))
    expected = by_hand(rows)
    rng.shuffle(rows)
    assert following(make(rows, SCHEMA), **limits) == expected


def test_copies_of_a_record(make):
    """Copies follow each other; the last of them takes the next record. All of them stay."""
    rows = [(1, "a", "2025-04-01 08:00", 1.0)] * 300 + [(2, "a", "2025-04-01 09:00", 2.0)]
    for limits in ({}, {"station_rows": 10}):
        found = pr.with_next_price(make(rows, SCHEMA), **limits).groupBy("id", "diesel_shift").count().collect()
        assert {(r.id, r.diesel_shift): r["count"] for r in found} == {(1, 1.0): 299, (1, 2.0): 1, (2, None): 1}


def test_one_key_is_spread_over_parts(make):
    """Even, bursting and undated records of one station, and copies of one record."""
    start = datetime(2025, 4, 1)
    even = [(i, start + timedelta(minutes=i)) for i in range(2000)]
    burst = [(i, start + timedelta(days=30 * (i == 0), milliseconds=i)) for i in range(2000)]
    undated = [(i, None) for i in range(2000)]
    copies = [(1, start)] * 2000
    for records in (even, burst, undated, copies):
        rows = [(i, "hot", m and m.isoformat(sep=" "), 1.0) for i, m in records]
        table = placed(make(rows, SCHEMA), ["uuid", *pr._in_order()], most=500)
        parts = table.groupBy("_part").count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 1000
        assert table.count() == 2000


def test_enrich_keeps_every_record(make, spark):
    prices = make([(1, "a", None, 1.0), (2, "x", None, 1.0), (3, None, None, 1.0)], SCHEMA)
    stations = spark.createDataFrame([("a", " aral", "n", 1.5), (None, "none", "m", 2.5)], "id string, brand string, name string, lat double")
    joined = pr.enrich(prices, stations)
    assert joined.columns == ["id", "uuid", "date", "diesel", "brand", "lat"]
    assert {r.id: r.brand for r in joined.collect()} == {1: " aral", 2: None, 3: None}  # NULL ids match nothing


def test_latest_station_version(spark):
    rows = [("a", "2", "2025-01-02", "new"), ("a", "1", "2025-01-01", "old"), ("b", "1", "2025-01-01", "only")]
    stations = spark.createDataFrame(rows, "id string, version string, version_time string, brand string")
    assert {r.id: r.brand for r in pr.latest_stations(stations).collect()} == {"a": "new", "b": "only"}


def test_recent_includes_the_cutoff(make):
    rows = [(1, "a", "2025-04-21 10:00", 1.0), (2, "a", "2025-04-21 09:59:59", 1.0), (3, "a", "2025-06-20 10:00", 1.0)]
    kept = pr.recent(make(rows, SCHEMA), 60, datetime(2025, 6, 20, 10))
    assert {r.id for r in kept.collect()} == {1, 3}
    assert pr.recent(make(rows, SCHEMA)).count() == 0


def test_feature_table(make, spark):
    raw = make(
        [(1, "a", "2025-04-21 10:05", 1700, -1, 1600, 1), (2, "a", "2025-04-21 11:05", 1700, 0, 1650, 1)],
        "id long, uuid string, date timestamp_ntz, e5 int, e10 int, diesel int, change int",
    )
    stations = spark.createDataFrame([("a", "aral", "01067", "by", 1.0, 2.0)], "id string, brand string, post_code string, public_holiday_identifier string, lat double, lng double")
    features = pr.price_features(raw, stations)
    assert set(features.columns) == {
        "id", "uuid", "e5", "e10", "diesel", "date", "brand", "hour", "minute", "month", "day", "hour_sin",
        "weekday_sin", "diesel_shift", "price_will_change",
    }
    final = pr.final_table(features)
    assert set(features.columns) - set(final.columns) == {"id", "date"}
    first = features.where("id = 1").first()
    assert (first.e5, first.e10, first.diesel, first.diesel_shift, first.price_will_change) == (1.7, None, 1.6, 1.65, 1)
    assert features.where("id = 2").first().e10 == 0.0
    with pytest.raises(ValueError):
        pr.final_table(final)
