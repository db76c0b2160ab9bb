"""The forecast sees only what was known before the day, and clock fields do not follow the machine."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricetide.functions.features import moment
from pricetide.operators import forecast as fc
from pricetide.operators import means as mn
from pricetide.operators.prices import latest_stations

SCHEMA = "id long, uuid string, date timestamp_ntz, e5 double"
START = datetime(2025, 4, 1, 9)
NAMES = ["e5_lag_1", "e5_lag_3", "e5_lag_7", "e5_7d_avg", "e5_volatility", "oil_price", "oil_7d_avg"]


def features(spark, rows, oil):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("day_key", F.to_date("date"))
    series = spark.createDataFrame(oil, "date date, close double")
    found = fc.forecast_rows(frame, mn.daily_means(frame, ["e5"]), series)
    return {r.id: tuple(r[name] for name in NAMES) for r in found.collect()}


def test_a_price_does_not_show_in_its_own_day(spark):
    rows = [(d * 10 + s, f"s{s}", START + timedelta(days=d, hours=s), 1.5 + 0.01 * d + 0.1 * s) for d in range(9) for s in range(3)]
    oil = [((START + timedelta(days=d)).date(), 60.0 + d) for d in range(9) if d not in (5, 6)]
    plain = features(spark, rows, oil)
    assert len(plain) == len(rows)
    day = 6
    changed = [(i, u, t, 9.0 if i == day * 10 + 1 else p) for i, u, t, p in rows]
    moved = features(spark, changed, oil)
    own = [i for i, _, t, _ in rows if t.date() <= (START + timedelta(days=day)).date()]
    assert {i: plain[i] for i in own} == {i: moved[i] for i in own}
    assert plain[71] != moved[71]
    other = [(d, 99.0 if d == (START + timedelta(days=4)).date() else c) for d, c in oil]
    assert sorted(i for i, v in features(spark, rows, other).items() if v != plain[i]) == [i for i, *_ in rows if i >= 50]
    lag_1, lag_3, lag_7, week, _, price, _ = plain[81]
    assert (lag_1, lag_3, lag_7) == pytest.approx((1.67, 1.65, 1.61)) and week == pytest.approx(1.64)
    assert price == 67.0 and plain[61][5] == plain[71][5] == 64.0  # the weekend carries Friday's close


def test_gaps_are_filled(spark):
    rows = [(1, "a", START, 1.5), (2, "a", START + timedelta(days=1), 1.6), (3, "b", START + timedelta(days=1), 1.7),
            (4, None, START + timedelta(days=1), 1.8), (5, "a", START + timedelta(days=2), None), (6, "c", START, 0.5)]
    found = features(spark, rows, [])
    assert found == {
        1: (0.0, 0.0, 0.0, 0.0, 0.0, 70.0, 70.0), 6: (0.0, 0.0, 0.0, 0.0, 0.0, 70.0, 70.0),
        2: (1.5, 1.5, 1.5, 1.5, 0.0, 70.0, 70.0), 3: (1.5, 1.5, 1.5, 1.5, 0.0, 70.0, 70.0),
        4: (1.5, 1.5, 1.5, 1.5, 0.0, 70.0, 70.0),
    }


def test_the_latest_version_is_the_highest_number(spark):
    rows = [("a", "9", "2025-01-01", "old"), ("a", "10", "2025-01-01", "new"), ("b", "x", "2025-01-02", "new"), ("b", "99", "2025-01-01", "old")]
    stations = spark.createDataFrame(rows, "id string, version string, version_time string, name string")
    assert {r.id: r.name for r in latest_stations(stations).collect()} == {"a": "new", "b": "new"}


def test_moments(spark):
    aware = datetime(2025, 4, 1, 12, tzinfo=timezone(timedelta(hours=2)))
    row = spark.range(1).select(moment(datetime(2025, 4, 1, 10)).alias("a"), moment(aware).alias("b")).first()
    assert row.a == row.b == datetime(2025, 4, 1, 10)


ZONED = """
import sys
import __spark_entry__ as registry
from pricetide.session import build_session

spark = build_session("zone", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
for name in sys.argv[1:]:
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    print("ROWS", name, len(rows), *sorted(repr(tuple(row)) for row in rows), sep="|")
"""


def test_machine_zone_changes_nothing(spark, tmp_path):
    """Queries that look at the clock give the same rows on machines of three zones, and here."""
    repo = Path(__file__).resolve().parents[1]
    names = ["q_recent_window", "q_live_features"]
    told = set()
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        env = os.environ | {"TZ": zone, "PYTHONPATH": f"{repo}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
        call = [sys.executable, "-c", ZONED, *names]
        done = subprocess.run(call, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-2000:]
        told.add(tuple(line for line in done.stdout.splitlines() if line.startswith("ROWS")))
    (lines,) = told
    sys.path.insert(0, str(repo))
    import __spark_entry__ as registry

    for line, name in zip(lines, names, strict=True):
        rows = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert line == "|".join(["ROWS", name, str(len(rows)), *sorted(repr(tuple(row)) for row in rows)]) and rows
