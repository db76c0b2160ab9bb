"""Live labels equal batch labels, whatever the batches are."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pricetide.operators import prices as pr
from pricetide.streaming import changes

SCHEMA = "id long, uuid string, date timestamp_ntz, diesel double"


def test_stream_against_batch(spark, make, tmp_path):
    rng = random.Random(2)
    start = datetime(2025, 4, 1)
    rows = [
        (i, rng.choice(["a", "a", "b", "c", None]), (start + timedelta(minutes=i // 2)).isoformat(sep=" "), rng.choice([1.5, 1.6, None]))
        for i in range(300)
    ]
    for part in range(3):  # three files, three micro-batches
        shuffled = rows[part * 100 : part * 100 + 100]
        rng.shuffle(shuffled)
        make(shuffled, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    changes.start(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()

    whole = pr.with_next(make(rows, SCHEMA), {"id": "next_id", "diesel": "diesel_shift"})
    expected = whole.where("next_id IS NOT NULL").drop("next_id").transform(pr.with_change_label)
    labels = changes.read_labels(spark, str(tmp_path / "out"))
    assert sorted(map(str, labels.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert labels.select("id").distinct().count() == labels.count()


def test_records_out_of_order(spark, make, tmp_path):
    """Files in any order give the labels of the batch operator in the end."""
    rng = random.Random(8)
    start = datetime(2025, 4, 1)
    rows = [
        (i, rng.choice(["a", "a", "b", "c", None]), (start + timedelta(minutes=i // 2)).isoformat(sep=" "), rng.choice([1.5, 1.6, None]))
        for i in range(240)
    ]
    mixed = list(rows)
    rng.shuffle(mixed)
    for part in range(6):
        make(mixed[part * 40 : part * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.start(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    whole = pr.with_next(make(rows, SCHEMA), {"id": "next_id", "diesel": "diesel_shift"})
    expected = whole.where("next_id IS NOT NULL").drop("next_id").transform(pr.with_change_label)
    labels = changes.read_labels(spark, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "records")).where("late").count() > 20
    assert sorted(map(str, labels.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    assert sorted(p.name for p in (tmp_path / "out" / "open").iterdir()) == ["batch=4", "batch=5"]


def test_late_records_are_told_apart(make):
    batch = make([(1, "a", "2025-04-01 08:00", 1.0), (3, "a", "2025-04-01 10:00", 1.2), (4, "b", "2025-04-01 07:00", 1.3)], SCHEMA)
    before = make([(2, "a", "2025-04-01 09:00", 1.1)], SCHEMA)
    placed = changes.placed_batch(batch, before)
    closed, still_open = changes.label_batch(placed, before)
    assert [(r.id, r.diesel_shift, r.price_will_change) for r in closed.collect()] == [(2, 1.2, 1)]
    assert {r.id for r in still_open.collect()} == {3, 4}
    late = placed.where("late")
    assert [r.id for r in late.collect()] == [1]
    mended = changes.corrections(before.unionByName(batch), late)
    assert [(r.id, r.diesel_shift) for r in mended.collect()] == [(1, 1.1)]
