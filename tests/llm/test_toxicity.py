from __future__ import annotations

import dataclasses
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricetide.llm import toxicity as tx
from pricetide.llm.common import read

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")
    index = tx.fit(docs, labels)
    return index, {r.doc_id: r for r in tx.toxicity(docs, index).collect()}


def plain_vector(text, idf):
    """TF-IDF of the known words, as a dictionary of length 1."""
    counts = Counter(w for w in tx.terms(text) if w in idf)
    weights = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items()}
    length = math.sqrt(sum(x * x for x in weights.values()))
    return {w: x / length for w, x in weights.items()} if length else {}


def test_nearest_is_exact(scored, spark, monkeypatch):
    """Cosines from dictionaries of words, against indexes of one block, of several and of many."""
    index = scored[0]
    texts = {r.doc_id: r.text for r in read(spark, SF_DIR, "documents").collect()}
    words = {w for i in index.ids.tolist() for w in tx.terms(texts[i])}
    df = Counter(w for text in texts.values() for w in set(tx.terms(text)) & words)
    idf = {w: math.log((len(texts) + 1) / (df[w] + 0.5)) for w in words}
    assert np.array_equal(np.sort(tx.digests(sorted(words))), index.vocabulary)
    examples = [plain_vector(texts[i], idf) for i in index.ids.tolist()]
    postings = defaultdict(list)
    for place, vector in enumerate(examples):
        for w, x in vector.items():
            postings[w].append((place, x))
    want = {}
    for i in list(texts)[:300]:
        sums = np.zeros(len(examples))
        for w, x in plain_vector(texts[i], idf).items():
            for place, y in postings[w]:
                sums[place] += x * y
        want[i] = sums
    skipped = 0
    for block in (64, 700, 1 << 14):
        monkeypatch.setattr(tx, "BLOCK", block)
        own = dataclasses.replace(index, blocks=None, seen={}).invert()
        assert len(own.blocks) == -(-len(examples) // block)
        looked = []
        real = tx.Postings.products
        monkeypatch.setattr(tx.Postings, "products", lambda self, *a, real=real: looked.append(a[3][0]) or real(self, *a))
        counted = list(own.counted([texts[i] for i in want]))
        found = [pair for low in range(0, len(counted), 7) for pair in own.nearest(counted[low : low + 7])]
        for i, (term, n), (at, cosine) in zip(want, counted, found, strict=True):
            if not len(term):
                assert not want[i].any() and not len(at)
                continue
            order = np.argsort(-want[i], kind="stable")
            met = np.cumsum(own.sizes[order])
            least = want[i][order[min(np.searchsorted(met, tx.NEIGHBOURS), len(order) - 1)]]
            assert np.allclose(cosine, want[i][at], atol=2e-6)
            assert set(np.flatnonzero(want[i] > max(least + 5e-6, 1e-8))) <= set(at.tolist()) <= set(np.flatnonzero(want[i] >= least - 5e-6))
        monkeypatch.setattr(tx.Postings, "products", real)
        skipped += len(own.blocks) * len(want) - sum(looked)
    assert skipped > 0


def test_held_out_labels(scored, spark):
    _, rows = scored
    held = [(rows[r.doc_id].score, r.toxic) for r in read(spark, SF_DIR, "labels").collect() if rows[r.doc_id].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(toxic) > 50
    area = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    right = np.mean([(s >= 0.5) == t for s, t in held])
    print("area", area, "accuracy", right, "recall", np.mean([s >= 0.5 for s in toxic]), "false", np.mean([s >= 0.5 for s in clean]))
    assert area > 0.94 and right > 0.95 and np.mean([s >= 0.5 for s in clean]) < 0.01
    for row in rows.values():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.5)


def test_held_out_labels_are_never_learnt(scored, spark):
    index, _ = scored
    docs, labels = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels")
    turned = labels.selectExpr(
        "doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, 1 - toxic, toxic) AS toxic"
    )
    again = tx.fit(docs, turned)
    assert (again.vocabulary == index.vocabulary).all() and (again.toxic == index.toxic).all() and (again.lean == index.lean).all()


def test_edges(spark):
    rows = [(i, "awful nasty thing" if i % 3 == 0 else "fine thing here", i) for i in range(200)]
    rows += [(1000, None, 1), (1001, "", 2), (None, "awful nasty", 3), (1002, "x " * 100_000, 4), (0, "fine", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i in range(200)] + [(0, None), (None, 1), (3, 1), (5000, 1)], "doc_id long, toxic int"
    )
    index = tx.fit(docs, labels)
    found = tx.toxicity(docs, index).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and 0 < r.doc_id < 200:
            assert r.predicted == (r.doc_id % 3 == 0)
    assert {r.predicted for r in found if r.doc_id in (1000, 1001, 1002)} == {0}
    kept = tx.remove_toxic(docs, index)
    assert kept.schema == docs.schema and kept.where("doc_id IS NULL").count() == 0
    nothing = tx.fit(docs, labels.limit(0))
    assert {r.predicted for r in tx.toxicity(docs, nothing).collect()} == {0}
    assert tx.toxicity(docs.limit(0), index).count() == 0
    bare = tx.fit(docs.limit(0), labels)
    assert len(bare.vocabulary) == 0


def test_all_terms_are_indexed(spark):
    """Terms of few rows and neutral ones have neighbours too; a toxic group in rare wording is found by them."""
    rows = [(i, f"plain words number{'abcdefghij'[i % 10]} here") for i in range(200)]
    rows += [(300 + i, "grubby wretch gnarl") for i in range(5)] + [(400, "wretch gnarl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows if i != 400], "doc_id long, toxic int")
    index = tx.fit(docs, labels)
    learnt = [text for i, text in rows if i != 400 and not tx.is_held_out(i)]
    assert set(index.vocabulary.tolist()) == set(tx.digests(sorted({term for text in learnt for term in tx.terms(text)})).tolist())
    assert 0 < sum(not tx.is_held_out(300 + i) for i in range(5)) < 6
    found = {r.doc_id: r for r in tx.toxicity(docs, index).collect()}
    assert all(len(found[i].neighbours) for i, _ in rows)
    assert found[400].score > found[1].score and found[400].neighbours[0] >= 300


def test_copies_vote_their_true_share(spark):
    """A thousand copies, 40 of them marked clean: all vote, whatever their labels and ids."""
    ids = [i for i in range(2000) if not tx.is_held_out(i)][:1000]
    rows = [(i, "vile filthy text") for i in ids] + [(5000 + i, f"fine thing {'abc'[i % 3] * 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for clean in (ids[:40], ids[-40:]):
        marked = [(i, int(i < 5000 and i not in clean)) for i, _ in rows]
        index = tx.fit(docs, spark.createDataFrame(marked, "doc_id long, toxic int"))
        index.invert()
        ((term, n),) = index.counted(["vile filthy text"])
        ((share, at, _),) = index.votes([(term, n)])
        assert abs(share - 0.96) < 1e-9 and index.sizes[at[0]] == 1000
        ((score, _, _),) = index.scores(["filthy vile text"])
        assert score > 0.5
