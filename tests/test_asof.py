from __future__ import annotations

import random

import pytest

from pricetide.operators.asof import attach_last

RECORDS, SERIES = "id long, uuid string, date timestamp", "uuid string, date timestamp, close double"


def by_hand(records, series, keyed):
    out = {}
    for key, uuid, date in records:
        known = [
            (at, close) for own, at, close in series
            if at is not None and date is not None and at <= date and (not keyed or own is not None and own == uuid)
        ]
        out[key] = max(known)[1] if known else None
    return out


def moment(minutes):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def tables():
    """One key holds a third of the records and most of the series; gaps of days; repeated moments."""
    rng = random.Random(5)
    keys = ["hot"] * 4 + ["a", "b", "c", "d", "e", "f", "without", None]
    records = [(i, rng.choice(keys), moment(rng.randrange(0, 9000, 5))) for i in range(400)]
    records += [(1000, "hot", None), (1001, None, None), (1002, "hot", moment(-1))]
    series = [(rng.choice(keys[:10]), moment(rng.randrange(0, 3000, 5)), float(rng.randrange(90))) for _ in range(150)]
    series += [("hot", moment(8000), 1.0), ("hot", moment(8000), 2.0), (None, moment(40), 3.0), ("a", None, 4.0)]
    return records, series


@pytest.mark.parametrize("fewest", [50_000, 60])
@pytest.mark.parametrize("keyed", [True, False])
def test_against_all_pairs(spark, tables, keyed, fewest):
    records, series = tables
    by = ["uuid"] if keyed else None
    found = attach_last(spark.createDataFrame(records, RECORDS), spark.createDataFrame(series, SERIES), ["close"], by=by, fewest=fewest)
    assert found.columns == ["id", "uuid", "date", "close"]
    assert {r.id: r.close for r in found.collect()} == by_hand(records, series, keyed)


def test_empty_tables_and_clashing_names(spark, tables):
    records, series = spark.createDataFrame(tables[0], RECORDS), spark.createDataFrame(tables[1], SERIES)
    alone = attach_last(records, series.limit(0), ["close"], by=["uuid"])
    assert alone.count() == len(tables[0]) and alone.where("close IS NOT NULL").count() == 0
    assert attach_last(records.limit(0), series, ["close"]).count() == 0
    with pytest.raises(ValueError, match="close"):
        attach_last(records.selectExpr("*", "1 AS close"), series, ["close"])
