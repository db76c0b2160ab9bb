from __future__ import annotations

import random

import pricetide.llm.jaccard_join as jaccard_join_module
from pricetide.llm import common
from pricetide.llm.common import components, tokens, written
from pricetide.llm.jaccard_join import jaccard_join, without_ids


def shingles(text):
    words = tokens(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def by_hand(rows):
    """(n_shingles, component) by comparing all pairs."""
    sets = [(key, shingles(text)) for key, text in rows]
    root = {key: key for key, _ in sets if key is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((key, len(s), find(key) if key is not None else None) for key, s in sets), key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def edited(words, rng, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_all_pairs(spark):
    """Chains, families with edits of several sizes, shared passages, copies, short texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 40, 120, 300]))
        for _ in range(12):
            rows.append(edited(base, rng, rng.randrange(8)))
    chain = rng.choices(vocabulary, k=100)
    for step in range(15):
        rows.append(list(chain))
        chain = chain[4:] + rng.choices(vocabulary, k=4)
    for extra in (5, 10, 14, 15, 16, 30, 200):
        rows += [passage + rng.choices(vocabulary, k=extra) for _ in range(8)]
    rows += [["Only", "four", "words", "here"], ["only", "FOUR", "words", "here"], ["a"], ["a"], []]
    rng.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(base, rng, rng.choice([0, 1, 2, 3, 4, 5, 6])))) for i in range(500)]
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(rows)


def shifted(base, rng, front, back):
    """The base without some words at its ends, and new words in their place."""
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    return new(front) + base[back : len(base) - front] + new(back)


def test_short_families_around_pivots(spark):
    """Families of 10 to 30 shingles, some with more than eight members: new words in front, at the end, or inside."""
    rng = random.Random(17)
    rows = []
    for family in range(90):
        base = [f"f{family}w{i}" for i in range(rng.randrange(14, 35))]
        for _ in range(rng.choice([3, 10, 14])):
            rows.append(shifted(base, rng, rng.randrange(4), 0))
        for _ in range(rng.choice([3, 10, 14])):
            rows.append(shifted(base, rng, 0, rng.randrange(4)))
        middle = shifted(base, rng, rng.randrange(3), rng.randrange(3))
        rows += [shifted(middle, rng, 0, rng.randrange(4)) for _ in range(rng.choice([0, 2, 9]))]
        rows += [edited(base, rng, 1) for _ in range(rng.choice([0, 1, 9]))]
    rng.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    assert got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == by_hand(rows)


def test_nulls_repeated_ids_and_clashing_columns(spark):
    rows = [
        (1, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 2, "x"), (2, None, 3, None), (3, "", 4, "y"),
        (4, " \t\n", 5, None), (None, "a b c d e f g", None, "z"), (7, "A B C D E F G", 6, "x"),
        (8, "p q r s t u", 7, "x"), (9, "p q r s t u", 8, "x"), (9, "a b c d e f g", 9, "x"), (5, "ü Ü é", 1, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id long, token string")
    found = got(jaccard_join(frame))
    assert found == sorted(
        [(1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 3, None), (7, 3, 1), (8, 2, 8), (9, 2, 1),
         (9, 3, 1), (5, 1, 5)], key=repr,
    )
    empty = jaccard_join(frame.limit(0))
    assert empty.collect() == [] and empty.columns[:3] == ["doc_id", "n_shingles", "component_id"]


def test_a_very_long_text(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:30_000]))]
    assert [r[2] for r in got(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))] == [1, 1, 3]


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.id, r.component) for r in found) == sorted((x, root[x]) for x in linked)


def test_rows_are_dropped_by_id(spark):
    rows = [(i, f"t{i}", None if i % 3 else i) for i in range(2000)] + [(None, "none", 1), (5, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    ids = spark.range(0, 4000, 5).withColumnRenamed("id", "doc_id")
    left = without_ids(docs, ids)
    assert left.schema == docs.schema
    assert sorted(map(repr, left.collect())) == sorted(map(repr, docs.where("doc_id IS NULL OR doc_id % 5 <> 0").collect()))
    assert without_ids(docs, ids.limit(0)).count() == len(rows)


def test_stars_take_no_round(spark, monkeypatch):
    """What the driver holds grows with its jobs: edges that are stars are written once and looked at once."""
    names = []
    monkeypatch.setattr(common, "written", lambda df, name: names.append(name) or written(df, name))
    stars = [(1, 5), (7, 1), (9, 1), (2, 3), (3, 2), (4, 4)]
    found = components(spark.createDataFrame(stars, "a long, b long"), "stars").collect()
    assert sorted((r.id, r.component) for r in found) == [(1, 1), (2, 2), (3, 2), (5, 1), (7, 1), (9, 1)]
    assert names == ["stars-edges"]


def test_ids_are_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(jaccard_join_module, "written", lambda df, name: names.append(name) or written(df, name))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id long, text string")
    assert without_ids(docs, docs.where("doc_id < 4").select("doc_id")).count() == 5
    assert len(names) == 1


def test_a_written_table_takes_one_job(spark):
    spark.sparkContext.setJobGroup("written-once", "")
    try:
        assert written(spark.range(5).toDF("a"), "test").schema.simpleString() == "struct<a:bigint>"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("written-once")) == 1
