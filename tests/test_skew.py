"""Joins without a broadcast: AQE splits the partitions of a hot key, and the rows stay the same."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from pricetide.operators import means as mn
from pricetide.operators import prices as pr

# Small limits, so that small test tables have skewed partitions.
LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture
def no_broadcast(spark):
    for key, value in LIMITS.items():
        spark.conf.set(key, value)
    yield
    for key in LIMITS:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def prices(spark, make):
    start = datetime(2025, 4, 1)
    rows = [
        (i, "hot" if i % 3 else f"s{i % 200}", (start + timedelta(seconds=i)).isoformat(sep=" "), 1.5 + i % 7 / 100)
        for i in range(12_000)
    ]
    frame = make(rows, "id long, uuid string, date timestamp_ntz, diesel double").repartition(12)
    return frame.transform(mn.with_day_key)


def run(frame):
    found = sorted(map(str, frame.collect()))
    return found, frame._jdf.queryExecution().executedPlan().toString()


def joins(prices, spark):
    stations = spark.createDataFrame([(f"s{i}", f"b{i % 5}") for i in range(200)] + [("hot", "h")], "id string, brand string")
    means = mn.rolling_means(mn.daily_means(prices, ["diesel"]), ["diesel"])
    return {"stations": pr.enrich(prices, stations), "means": mn.attach_means(prices, means)}


def test_hot_keys_are_split(spark, prices, no_broadcast):
    split = {name: run(frame) for name, frame in joins(prices, spark).items()}
    for name, (_, plan) in split.items():
        assert "skew=true" in plan, f"{name}: {plan}"
    for key in LIMITS:
        spark.conf.unset(key)
    whole = {name: run(frame) for name, frame in joins(prices, spark).items()}
    for name in split:
        assert split[name][0] == whole[name][0] and len(whole[name][0]) == 12_000
