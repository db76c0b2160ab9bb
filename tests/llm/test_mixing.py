from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from pricetide.llm import mixing
from pricetide.llm.common import read
from pricetide.llm.mixing import fair_mix, mixed


def water(sizes, share=1.5, copies=2):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > copies * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = copies * sizes[s]
            left -= target[s]
        free -= over
    return target


def by_hand(rows):
    """(id, size, taken) of all rows, one copy at a time."""
    sized = [(key, len((text or "").encode().split()), source) for key, text, source in rows]
    sizes = defaultdict(int)
    for _, n, source in sized:
        sizes[source] += n
    target = water(sizes)
    events = []
    for source in sizes:
        order = sorted((hashlib.md5(str("" if k is None else k).encode()).hexdigest(), k, n) for k, n, s in sized if s == source)
        served = 0
        for turn in range(2):
            for digest, key, n in order:
                served += n
                if target[source] > 0:
                    events.append((served / target[source], "" if source is None else "s" + source, digest, key, n, turn))
    events.sort()
    budget, total, taken = sum(target.values()), 0, defaultdict(int)
    for event in events:
        total += event[4]
        if total > budget * (1 + 1e-9):
            break
        taken[event[3]] += event[4]
    return {k: (n, sizes[s], target[s], taken[k]) for k, n, s in sized}


def rows_of(frame):
    return {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in frame.collect()}


@pytest.mark.parametrize("window_rows", [10_000, 50])
def test_against_brute_force(spark, monkeypatch, window_rows):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", window_rows)
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()])
    found = rows_of(fair_mix(docs))
    assert found.keys() == want.keys()
    for key, row in want.items():
        assert found[key] == pytest.approx(row)


def test_targets_are_met(spark):
    rows = fair_mix(read(spark, "/root/testdata/sf0.1", "documents")).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    for source, want in target.items():
        assert abs(taken[source] - want) < 0.05 * want


def test_hot_small_and_missing_sources(spark):
    rows = [(i, "a b c", "hot") for i in range(600)] + [(1000 + i, "x " * (i % 7), "b") for i in range(50)]
    rows += [(2000, "one", "tiny"), (2001, None, None), (2002, "a b", None), (2003, "", "empty"), (2004, None, "empty")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, found = by_hand(rows), rows_of(fair_mix(frame))
    for key, row in want.items():
        assert found[key] == pytest.approx(row)
    often = mixed(frame.withColumn("taken", frame.doc_id).withColumn("key", frame.source))
    assert often.columns == ["doc_id", "text", "source", "taken", "key"]
    sizes = {k: row[0] for k, row in found.items()}
    copies = defaultdict(int)
    for r in often.collect():
        copies[r.doc_id] += 1
    assert {k: n * sizes[k] for k, n in copies.items() if sizes[k]} == {k: r[3] for k, r in found.items() if r[3]}


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b c", "s")] * 4 + [(None, "d e f", "s"), (2, "g", "t"), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = fair_mix(frame).collect()
    assert len(found) == len(rows) and all(r.taken <= 2 * r.size for r in found)
    assert fair_mix(frame.limit(0)).collect() == [] and mixed(frame.limit(0)).collect() == []
    nothing = fair_mix(spark.createDataFrame([(1, None, "s"), (2, "", "t")], "doc_id long, text string, source string"))
    assert {(r.target, r.taken) for r in nothing.collect()} == {(0.0, 0)}
