from __future__ import annotations

import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from pricetide.llm import brown_lm as lm
from pricetide.llm.common import read, tokens

SF_DIR = "/root/testdata/sf0.01"


def is_held_out(key):
    return zlib.crc32(str(key).encode()) % 7 == 2


def checked(spark, docs):
    """All columns but the score against first principles; returns rows, model and training counts."""
    model, counts = lm.fit(docs)
    rows = lm.score(docs, model, counts).collect()
    texts = [(r.doc_id, [*tokens(r.text), lm.END]) for r in docs.collect()]
    seen = Counter(w for key, words in texts if key is None or not is_held_out(key) for w in words)
    n, v = sum(seen.values()), len(seen)
    want = sorted(
        (
            (
                repr(key), key is not None and is_held_out(key), len(words), sum(w in seen for w in words), n,
                round(sum(log10((seen[w] + 1) / (n + v + 1)) for w in words), 6),
            )
            for key, words in texts
        )
    )
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-4)
    return rows, model, seen


def test_documents(spark):
    rows, _, _ = checked(spark, read(spark, SF_DIR, "documents"))
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


@pytest.mark.parametrize("sizes", [None, (64, 32, 16)])
def test_probabilities_sum_to_one(spark, monkeypatch, sizes):
    """Over all training words and one for all others, after any two classes; with every tier of words in use."""
    if sizes:
        for name, size in zip(("COUNTED", "CLASSED", "EXCHANGED"), sizes):
            monkeypatch.setattr(lm, name, size)
        monkeypatch.setattr(lm, "CLASSES", 6)
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows, model, seen = checked(spark, docs)
    assert np.allclose((10.0**model.steps).sum(axis=2), 1)
    size = lm.CLASSES + 2
    share = np.zeros(size)
    share[lm.CLASSES] = 1
    for word, n in seen.items():
        if word == lm.END:
            continue
        i = model.ids.get(word)
        kind = model.of[i] if i is not None else lm.CLASSES + 1
        share[kind] += 10 ** (model.emit[i] if i is not None else model.other(n))
    share[lm.CLASSES + 1] += 10**model.unseen
    used = np.unique(np.append(model.of, [lm.CLASSES, lm.CLASSES + 1]))
    assert np.allclose(share[used], 1)
    # A document's score, token by token.
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in rows[:20]:
        a = b = lm.CLASSES
        total = 0.0
        for word in [*tokens(texts[row.doc_id]), lm.END]:
            i = model.ids.get(word)
            kind = lm.CLASSES if word == lm.END else model.of[i] if i is not None else lm.CLASSES + 1
            total += model.steps[a, b, kind]
            if word != lm.END:
                total += model.emit[i] if i is not None else model.other(seen[word]) if word in seen else model.unseen
            a, b = b, kind
        assert row.score == pytest.approx(total)
        assert row.perplexity == pytest.approx(10 ** (-total / row.n_tokens))


def test_exchange_finds_classes():
    """Two kinds of words that follow each other in turn end in different classes."""
    rng = np.random.default_rng(4)
    n = 40
    pairs = np.zeros((n + 1, n + 1))
    kinds = rng.permutation(np.arange(n) % 2)
    for _ in range(8000):
        a = rng.integers(n)
        b = rng.choice(np.flatnonzero(kinds != kinds[a]))
        pairs[a, b] += 1
    pairs[n, 0] = pairs[1, n] = 1
    of = lm.exchange(pairs, classes=2)
    assert of[n] == 2 and len(set(zip(of[:n].tolist(), kinds.tolist()))) == 2


def test_edges(spark):
    rows = [(i, "The cat sat on the mat", "x") for i in range(30)]
    rows += [(100, None, "x"), (101, "", "y"), (None, "the Dog", "z"), (3, "the cat", "x"), (102, "a b " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    found, _, _ = checked(spark, docs)
    assert len(found) == len(rows) and all(np.isfinite(r.score) and r.score <= 0 for r in found)
    model, counts = lm.fit(docs.limit(0))
    alone = lm.score(docs, model, counts).collect()
    assert {(r.train_tokens, r.n_known) for r in alone} == {(0, 0)} and all(np.isfinite(r.score) for r in alone)
    assert lm.score(docs.limit(0), *lm.fit(docs)).count() == 0


def test_scores_are_finite(spark):
    """Words that all occur once, or never exactly twice: no word of a text gets probability 0."""
    once = [(i, " ".join(f"u{i}x{k}" for k in range(9))) for i in range(300)]
    never_twice = once + [(1000 + i, "and so on and so on " + f"v{i}") for i in range(300)]
    for rows in (once, never_twice):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found, _, seen = checked(spark, docs)
        assert 2 not in set(seen.values())
        assert all(np.isfinite(r.score) and r.score < 0 and np.isfinite(r.perplexity) for r in found)


def test_no_neighbour_is_left_out(spark, monkeypatch):
    """The exchange sees every pair of neighbours of the training texts, those with rare words as well."""
    monkeypatch.setattr(lm, "EXCHANGED", 9)
    monkeypatch.setattr(lm, "CLASSED", 12)
    monkeypatch.setattr(lm, "CLASSES", 3)
    seen, exchange = [], lm.exchange
    monkeypatch.setattr(lm, "exchange", lambda pairs, *a, **k: seen.append(pairs.copy()) or exchange(pairs, *a, **k))
    rows = [(i, f"the cat of w{i} and the dog of w{i % 7} or w{i + 1}") for i in range(60)]
    rows = [row for row in rows if not is_held_out(row[0])]
    model, _ = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [[*tokens(text), lm.END] for _, text in rows]
    (pairs,) = seen
    assert pairs.sum() == sum(map(len, texts)) == model.n
    near = len(pairs) - 2
    row = {**{w: i for w, i in model.ids.items() if i < near}, lm.END: near}
    want = np.zeros_like(pairs)
    for words in texts:
        for a, b in zip([lm.END, *words], words):
            want[row.get(a, near + 1), row.get(b, near + 1)] += 1
    assert (pairs == want).all() and want[near + 1].any() and want[:, near + 1].any()
    assert all(model.of[i] < lm.CLASSES for i in range(near))


@pytest.mark.parametrize("sizes", [(64, 32, 16), (24, 24, 16)])
def test_every_word_has_a_class(spark, monkeypatch, sizes):
    """Words outside the tables are in the class that fits all their neighbours best, and trigrams count them there."""
    for name, size in zip(("COUNTED", "CLASSED", "EXCHANGED"), sizes):
        monkeypatch.setattr(lm, name, size)
    monkeypatch.setattr(lm, "CLASSES", 6)
    monkeypatch.setattr(lm, "TASK_CHARS", 3000)
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model, _ = lm.fit(docs)
    texts = [[*tokens(r.text), lm.END] for r in docs.collect() if not is_held_out(r.doc_id)]
    seen = Counter(w for words in texts for w in words)
    assert {w: model.counts[i] for w, i in model.ids.items()} == {w: n for w, n in seen.items() if w != lm.END}
    assert len(seen) > 10 * sizes[0] and len(model.ids) == len(model.of) == model.v - 1 and (model.of < lm.CLASSES).all()

    size, near = lm.CLASSES + 2, sizes[2] - 1
    kind = {w: int(model.of[i]) if i < near else size - 1 for w, i in model.ids.items()} | {lm.END: size - 2}
    grid, found = np.full((size, size), 0.1), {w: np.zeros((2, size)) for w in seen}
    for words in texts:
        for before, word, after in zip([lm.END, *words], words, [*words[1:], lm.END]):
            grid[kind[before], kind[word]] += 1
            if word != lm.END:
                found[word][0, kind[before]] += 1
                found[word][1, kind[after]] += 1
    inward = np.log(grid[:, :-2] / grid[:, :-2].sum(axis=0))
    onward = np.log(grid[:-2] / grid[:-2].sum(axis=1, keepdims=True)).T
    for word, i in model.ids.items():
        if i >= near:
            fits = found[word][0] @ inward + found[word][1] @ onward + np.log(grid[:, :-2].sum(axis=0))
            assert fits[model.of[i]] == pytest.approx(fits.max(), abs=1e-6)

    of = {w: int(model.of[i]) for w, i in model.ids.items()} | {lm.END: size - 2}
    cube = np.zeros((size, size, size))
    for words in texts:
        for share, once in ((1 - model.discount, None), (model.discount, size - 1)):
            kinds = [lm.CLASSES] * 2 + [once if once and seen[w] == 1 and w != lm.END else of[w] for w in words]
            for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
                cube[a, b, c] += share
    assert np.allclose(lm._log_steps(cube), model.steps)


def test_fit_and_score_at_once(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model, counts = lm.fit(docs)
    apart = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    for row in lm.fit_score(docs).collect():
        want = apart.pop(row.doc_id)
        assert row[:5] == want[:5] and np.allclose(row[5:], want[5:])
    assert not apart
