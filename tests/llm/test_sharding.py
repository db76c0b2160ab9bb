from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from pricetide.llm import sharding
from pricetide.llm.common import read
from pricetide.llm.sharding import shard


def checked(rows, texts, shards):
    """Sizes, digests and slots are right; returns the bytes of the shards."""
    filled, slots = [0] * shards, defaultdict(list)
    for row in rows:
        filled[row.shard] += row.size
        slots[row.shard].append(row.slot)
        assert row.law == "bytes" and row.grown_shard is None
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    want = sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    return filled


def test_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows, texts = shard(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]
    filled = checked(rows, texts, 8)
    assert max(filled) < 1.02 * min(filled)
    place = {r.doc_id: r.shard for r in rows}
    groups = defaultdict(set)
    for key, text in texts:
        groups[text].add(place[key])
    assert {len(g) for g in groups.values()} == {1}


@pytest.mark.parametrize("range_rows", [1_000_000, 100])
def test_hot_group_is_subdivided(spark, monkeypatch, range_rows):
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    texts = [(i, "hot text " * 20) for i in range(2000)] + [(5000 + i, f"text {i} " * 12) for i in range(4000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    filled = checked(shard(frame, 8).collect(), texts, 8)
    assert max(filled) < 1.02 * min(filled)


def test_edges(spark):
    texts = [(1, None), (2, ""), (None, "x"), (3, "é"), (3, "é"), (4, "y" * 100_000)]
    frame = spark.createDataFrame([(*t, "k", 1) for t in texts], "doc_id long, text string, key string, range int")
    rows = shard(frame, 3).collect()
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(
        [(1, 1), (2, 1), (None, 2), (3, 3), (3, 3), (4, 100_001)], key=repr
    )
    assert {r.shard for r in rows} <= {0, 1, 2}
    assert shard(frame.limit(0)).collect() == []
