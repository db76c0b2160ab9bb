"""Global index, day index, splits, folds, dictionaries."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest

from pricetide.operators import encode as en
from pricetide.operators import split as sp
from pricetide.operators import frames
from pricetide.operators.frames import placed, with_global_index


def test_global_index(spark, monkeypatch):
    monkeypatch.setattr(frames, "placed", lambda df, order, unique: placed(df, order, unique, most=60))  # nine parts
    values = list(range(500))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v // 100, f"{v:03d}") for v in values], "a int, b string")
    indexed = with_global_index(frame.repartition(7), ["a", "b"]).collect()
    assert all(row.row_idx == int(row.b) for row in indexed) and len(indexed) == 500


@pytest.fixture(scope="module")
def rows(spark):
    start = date(2025, 3, 1)
    made = [(d * 10 + i, start + timedelta(days=d), i % 2) for d in range(40) for i in range(5) if d != 17]
    return spark.createDataFrame(made, "id long, day_key date, price_will_change int")


def test_split_of_the_last_days(rows):
    split = sp.with_day_split(rows)
    days = {r.day_key: (r.day_idx, r.split) for r in split.collect()}
    assert sorted(i for i, _ in days.values()) == list(range(10, 40))  # 39 observed days, the last 30
    assert sum(s == "train" for _, s in days.values()) == 21
    assert sum(s == "test" for _, s in days.values()) == 9
    assert max(d for d, (_, s) in days.items() if s == "train") < min(d for d, (_, s) in days.items() if s == "test")
    assert split.count() == 30 * 5


def test_resplit(rows):
    valid = sp.resplit(sp.with_day_split(rows), 24)
    counts = {r.split: r["count"] for r in valid.groupBy("split").count().collect()}
    assert counts == {"train": 25 * 5, "valid": 5 * 5}
    assert "split" in valid.columns and len(valid.columns) == 5


def test_train_rows(spark):
    made = [(1, 1.0, 1.1, 1), (2, None, 1.1, 1), (3, 1.0, None, 1)]
    frame = spark.createDataFrame([(*r, 2.0, 2.0) for r in made], "id int, diesel double, diesel_shift double, price_will_change int, e5 double, e10 double")
    kept = sp.train_rows(frame)
    assert [r.id for r in kept.collect()] == [1]
    assert "e5" not in kept.columns


def dealt_folds(labels, k):
    """Contiguous stratified folds by definition: sorted labels dealt in turn, then filled in order."""
    seen = list(dict.fromkeys(labels))
    codes = np.array([seen.index(label) for label in labels])
    in_line = np.sort(codes)
    per_fold = np.array([np.bincount(in_line[i::k], minlength=len(seen)) for i in range(k)])
    folds = np.empty(len(labels), dtype=int)
    for c in range(len(seen)):
        folds[codes == c] = np.repeat(np.arange(k), per_fold[:, c])
    return folds.tolist()


@pytest.mark.parametrize("k,n,seed", [(4, 103, 1), (2, 50, 2), (5, 61, 3)])
def test_stratified_folds(spark, k, n, seed):
    rng = random.Random(seed)
    labels = [int(rng.random() < 0.7) for _ in range(n)]
    made = [(i, i // 10, label) for i, label in enumerate(labels)]
    rng.shuffle(made)
    frame = spark.createDataFrame(made, "id int, day int, y int")
    folded = sp.stratified_folds(frame, k, ["day", "id"], "y").orderBy("id").collect()
    assert [r.fold for r in folded] == dealt_folds(labels, k)


def test_hash_folds(rows):
    folded = sp.hash_folds(rows, 3)
    assert {r.fold for r in folded.collect()} == {0, 1, 2}
    assert folded.count() == rows.count()


def test_codes(spark):
    brands = spark.createDataFrame([("esso",), (" Aral",), (None,), ("shell ",), ("ARAL",)], "brand string")
    codes = en.category_codes(brands, "brand")
    assert {r.value: r.code for r in codes.collect()} == {"ARAL": 0, "ESSO": 1, "SHELL": 2}
    more = brands.unionAll(spark.createDataFrame([("jet",)], "brand string"))
    encoded = en.encode(more, codes, "brand", "code")
    assert {(r.brand or "").strip().upper(): r.code for r in encoded.collect()} == {"ESSO": 1, "ARAL": 0, "": 3, "SHELL": 2, "JET": 3}
    assert en.encode(more, codes, "brand").columns == ["brand"]


def test_codes_read_their_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)
    values = spark.sparkContext.parallelize(["esso", " Aral", "shell ", "ARAL"], 2).map(lambda value: (reads.add(1), (value,))[1])
    codes = en.category_codes(spark.createDataFrame(values, "brand string"), "brand")
    assert {r.value: r.code for r in codes.collect()} == {"ARAL": 0, "ESSO": 1, "SHELL": 2}
    assert reads.value == 4  # counting, sampling and numbering see the written dictionary
