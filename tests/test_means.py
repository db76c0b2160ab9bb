"""Daily and rolling means, lags, oil."""

from __future__ import annotations

import statistics
from datetime import date

import pytest

from pricetide.operators import means as mn

SCHEMA = "uuid string, date timestamp_ntz, e5 double, e10 double, diesel double"


def records(make, rows):
    return make([(u, d, e5, e10, di) for u, d, e5, e10, di in rows], SCHEMA)


def days(frame, column, day="day_key"):
    return [getattr(r, column) for r in frame.orderBy("uuid", day).collect()]


def test_daily_means_use_plausible_prices(make):
    rows = [
        ("a", "2025-04-01 08:00", 1.5, 0.0, 0.9),
        ("a", "2025-04-01 09:00", 1.7, None, None),
        ("a", "2025-04-02 09:00", 1.0, 1.0, 0.5),  # nothing above one euro: no row
        (None, "2025-04-01 09:00", 1.9, 1.9, 1.9),  # no station: no row
    ]
    daily = mn.daily_means(mn.with_day_key(records(make, rows)))
    (row,) = daily.collect()
    assert (row.uuid, row.day_key, row.e5_1d_mean, row.e10_1d_mean, row.diesel_1d_mean) == ("a", date(2025, 4, 1), 1.6, None, None)


def test_rolling_counts_days_on_which_the_fuel_was_seen(make):
    """e5 is missing on the third day: its frame reaches one day further back than the other fuels'."""
    e5 = [2.0, 3.0, None, 4.0, 5.0]
    rows = [("a", f"2025-04-0{i + 1} 08:00", p, 2.0, float(i + 2)) for i, p in enumerate(e5)]
    rolled = mn.rolling_means(mn.daily_means(mn.with_day_key(records(make, rows))))
    assert days(rolled, "e5_3d_mean") == [2.0, 2.5, None, 3.0, 4.0]
    assert days(rolled, "e5_7d_mean") == [2.0, 2.5, None, 3.0, 3.5]
    assert days(rolled, "diesel_3d_mean") == [2.0, 2.5, 3.0, 4.0, 5.0]
    assert set(days(rolled, "e10_7d_mean")) == {2.0}


def test_calendar_frame_and_narrow_mean(make):
    rows = [("a", f"2025-04-{d} 08:00", p, 2.0, 2.0) for d, p in (("01", 2.0), ("02", 3.0), ("05", 4.0))]
    daily = mn.daily_means(mn.with_day_key(records(make, rows)))
    assert days(mn.rolling_means(daily, frame="calendar"), "e5_3d_mean") == [2.0, 2.5, 4.0]
    assert days(mn.rolling_means(daily), "e5_3d_mean") == [2.0, 2.5, 3.0]
    assert dict(mn.rolling_means(daily, narrow_short=True).dtypes)["e5_3d_mean"] == "float"
    with pytest.raises(ValueError):
        mn.rolling_means(daily, frame="weeks")


def test_day_key_over_new_year(make):
    moments = ["2024-12-30", "2024-12-31", "2025-01-01", "2025-01-02"]
    rows = [("a", f"{m} 08:00", 2.0, 2.0, float(i + 2)) for i, m in enumerate(moments)]
    by_date = mn.rolling_means(mn.daily_means(mn.with_day_key(records(make, rows))))
    assert days(by_date, "diesel_3d_mean") == [2, 2.5, 3, 4]
    mmdd = mn.rolling_means(mn.daily_means(mn.with_day_key(records(make, rows), "mmdd")))
    assert days(mmdd, "diesel_3d_mean") == pytest.approx([4, 4.5, 11 / 3, 10 / 3])


def test_attach_keeps_every_record(make):
    rows = [("a", "2025-04-01 08:00", 1.5, 1.5, 1.5), ("a", "2025-04-02 08:00", 0.5, 0.5, 0.5), (None, "2025-04-01 08:00", 1.5, 1.5, 1.5)]
    keyed = mn.with_day_key(records(make, rows))
    joined = mn.attach_means(keyed, mn.rolling_means(mn.daily_means(keyed)))
    assert sorted((r.uuid or "", r.e5, r.e5_7d_mean) for r in joined.collect()) == [("", 1.5, None), ("a", 0.5, None), ("a", 1.5, 1.5)]


def test_lags(spark):
    values = [1.0 + i / 10 for i in range(9)]
    daily = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "uuid string, day_key int, e5_1d_mean double")
    lagged = mn.lag_features(daily).orderBy("day_key").collect()
    last = lagged[-1]
    assert (last.e5_lag_1, last.e5_lag_3, last.e5_lag_7) == (values[7], values[5], values[1])
    assert last.e5_7d_avg == pytest.approx(statistics.mean(values[2:]))
    assert last.e5_volatility == pytest.approx(statistics.stdev(values[2:]))
    assert (lagged[0].e5_lag_1, lagged[0].e5_volatility) == (None, 0.0)


def test_oil_join(make, spark):
    prices = make([("a", "2025-04-04 23:00", 1.0, 1.0, 1.0), ("a", "2025-04-05 01:00", 1.0, 1.0, 1.0)], SCHEMA)
    oil = spark.createDataFrame([(date(2025, 4, 4), 70.0), (date(2025, 4, 4), 70.0), (date(2025, 4, 3), 68.0)], "date date, close double")
    joined = mn.attach_oil(prices, mn.oil_features(oil)).orderBy("date").collect()
    assert [(r.oil_price, r.oil_7d_avg) for r in joined] == [(70.0, 69.0), (None, None)]
    assert [r.date for r in mn.skip_first_day(mn.one_close_per_day(oil)).collect()] == [date(2025, 4, 4)]
