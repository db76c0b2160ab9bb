"""Scalar rules: parsing, cleaning, calendar fields, labels."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pricetide.functions import features as fx
from pricetide.functions import text as tx


def column(spark, values, expression, schema="v string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [row.r for row in frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_strict_timestamps(spark):
    offsets = ["+02", "+0200", "+02:00", "Z", ".123+02", "", "+2"]
    texts = [f"2025-04-21 10:00:00{o}" for o in offsets] + ["2025-04-21", "2025-02-30 10:00:00+02", None]
    eight, ten = datetime(2025, 4, 21, 8), datetime(2025, 4, 21, 10)
    assert column(spark, texts, tx.parse_utc) == [eight, eight, eight, ten] + [None] * 6


def test_utc_whatever_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:  # the hour that clocks skip in Berlin
        assert column(spark, ["2025-03-30 02:30:00+00"], tx.parse_utc) == [datetime(2025, 3, 30, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_category_cleaning(spark):
    assert column(spark, [" a ", "\tq", "ß ", " x y\n", None], tx.clean_category) == ["A", "Q", "SS", "X Y", None]


def test_strip_removes_what_python_strips(spark):
    texts = [f"{c}a{c}b{c}{c}" for c in tx.WHITE_SPACE] + ["", " \t ", "\u200ba", "é\u3000", "\u2003"]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]


def test_post_codes(spark):
    assert column(spark, ["01067", "\\N", "x", "12.0"], lambda v: tx.to_int(tx.null_marker(v))) == [1067, None, None, 12]


def test_prices_in_euros(spark):
    assert column(spark, [-1, 0, 1799, None], fx.euros, "v int") == [None, 0.0, 1.799, None]


def test_time_features(spark):
    moment = datetime(2025, 4, 21, 22, 5)  # a Monday
    frame = spark.createDataFrame([(moment,)], "v timestamp_ntz")
    row = frame.select(*[e.alias(n) for n, e in fx.time_features(F.col("v")).items()]).first()
    assert (row.hour, row.minute, row.month, row.day, row.weekday) == (22, 5, 4, 21, 0)
    assert row.hour_sin == pytest.approx(math.sin(2 * math.pi * 22 / 24))
    assert row.hour_cos == pytest.approx(math.cos(2 * math.pi * 22 / 24))
    assert row.weekday_sin == 0.0
    local = frame.select(F.hour(fx.local_time(F.col("v"), "Europe/Berlin")).alias("h")).first()
    assert local.h == 0


def test_change_label(spark):
    pairs = [(1.0, 1.0), (1.0, 2.0), (None, 1.0), (1.0, None), (None, None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    labels = frame.select("i", fx.change_label(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    assert [row.y for row in labels] == [0, 1, 1, 1, 1]


def test_day_keys(spark):
    days = [datetime(2024, 12, 31, 23, 59), datetime(2025, 1, 1)]
    assert column(spark, days, lambda v: fx.day_key(v, "mmdd"), "v timestamp_ntz") == [1231, 101]
    assert column(spark, days, fx.day_key, "v timestamp_ntz") == [date(2024, 12, 31), date(2025, 1, 1)]
    with pytest.raises(ValueError):
        fx.day_key(F.col("v"), "week")


def test_threshold_is_strict(spark):
    assert column(spark, [0.59, 0.5900001, 0.0], lambda v: fx.over_threshold(v, 0.59), "v double") == [0, 1, 0]
