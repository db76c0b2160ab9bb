from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm.common import read
from pricetide.llm.decontaminate import Item, Searcher, find_items, nearest_part, normalised, remove_contaminated


def least_distance(pattern, text):
    """Edit distance of the pattern to the nearest part of the text, cell by cell."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for char in text:
        above, column[0] = column[0], 0
        for i, own in enumerate(pattern, 1):
            above, column[i] = column[i], min(above + (own != char), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=80), st.text("ab ", max_size=90))
def test_myers_equals_the_table(pattern, text):
    distance, end = nearest_part(pattern, text)
    assert distance == least_distance(pattern, text)
    assert distance == least_distance(pattern, text[:end])


def spoilt(text, rng, times):
    chars = list(text)
    for _ in range(times):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[at : at + (kind != 1)] = [rng.choice("abcdefgh")] if kind != 2 else []
    return "".join(chars)


def test_every_hit_within_the_budget_is_found():
    """Random edits around the budget, in random surroundings, against the whole table."""
    rng = random.Random(1)
    letters = "abcdefghij   "
    items = [Item.of(i, "".join(rng.choices(letters, k=rng.randrange(30, 160))), 0.05) for i in range(12)]
    searcher = Searcher(items)
    found = 0
    for _ in range(150):
        item = rng.choice(items)
        text = "".join(rng.choices(letters, k=200)) + spoilt(item.text, rng, rng.randrange(0, 12))
        text = normalised(text + "".join(rng.choices(letters, k=200)))
        hits = searcher.hits(text)
        for number, own in enumerate(items):
            distance = least_distance(own.text, text)
            assert (number in hits) == (distance <= own.budget)
            if number in hits:
                assert hits[number][0] == distance
                found += 1
    assert found > 30


def test_documents(spark):
    docs, items = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "benchmark")
    found = {(r.doc_id, r.item_id): r.distance for r in find_items(docs, items).collect()}
    own = [(r.doc_id, normalised(r.text)) for r in docs.collect()]
    exact = {(d, r.item_id) for r in items.collect() for d, text in own if normalised(r.text).strip() in text}
    assert exact <= {k for k, distance in found.items() if distance == 0} and len(exact) > 5
    kept = {r.doc_id for r in remove_contaminated(docs, items).collect()}
    assert kept == {d for d, _ in own} - {d for d, _ in found}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", None), (3, "say YES, now", 1), (4, "yesterday", 2), (None, "yes", 3), (3, "yes", 4)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(1, "Yes!"), (2, None), (3, ""), (4, "yes"), (1, "Yes!")], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.distance) for r in find_items(docs, items).collect()), key=repr)
    want = [(3, 1, 0), (3, 4, 0), (None, 1, 0), (None, 4, 0), (3, 1, 0), (3, 4, 0)]
    assert found == sorted(want, key=repr)
    left = remove_contaminated(docs, items)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]
    assert find_items(docs, items.limit(0)).count() == 0 and find_items(docs.limit(0), items).count() == 0
    assert remove_contaminated(docs, items.limit(0)).count() == 6
