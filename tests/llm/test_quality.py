from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter

import numpy as np

from pricetide.llm import quality as ql
from pricetide.llm.common import read


def test_label_model_finds_the_accuracies():
    """Votes drawn from known rates; the posterior follows Bayes' rule with these rates."""
    rng = np.random.default_rng(2)
    right = np.array([0.9, 0.85, 0.8, 0.7, 0.95])
    truth = rng.random(20_000) < 0.7
    opinion = rng.random((len(truth), len(right))) < 0.6
    good = np.where(rng.random(opinion.shape) < right, truth[:, None], ~truth[:, None])
    letters = np.where(~opinion, ql.NONE, np.where(good, ql.GOOD, ql.BAD))
    names, counts = np.unique(["".join(v) for v in letters], return_counts=True)
    found = ql.label_model(dict(zip(names.tolist(), counts.tolist())))
    for name in names:
        odds = 0.7 / 0.3
        for letter, p in zip(name, right):
            odds *= {ql.GOOD: p / (1 - p), ql.BAD: (1 - p) / p, ql.NONE: 1}[letter]
        assert abs(found[name] - odds / (1 + odds)) < 0.12
    assert ql.label_model({}) == {}


def plain_votes(text):
    """The labellers on one text, word by word and character by character."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    text, some = text or "", max(1, len(words))
    letters = sum(c.isalpha() for c in text)
    marks = len(re.findall(r"(?:[^\W\d_]|[.,])[*#$%&!?=+~^]{2,}", text))
    capitals = sum(unicodedata.category(c) == "Lu" for c in text) / max(1, letters)
    lonely = sum(not any(unicodedata.category(c)[0] in "LN" for c in w) for w in words) / some
    echoes = sum(a == b for a, b in zip(words, words[1:])) / some
    common = sum(w in ql.FUNCTION_WORDS for w in words) / some
    stops = sum(a.isalpha() and b in ".!?" and (c == "" or c in " \t\n\x0b\x0c\r") for a, b, c in zip(text, text[1:], [*text[2:], ""])) / some
    wordy = max(1, letters) / some
    vote = lambda bad, good=False: ql.BAD if bad else ql.GOOD if good else ql.NONE
    return "".join([
        vote(marks / some > 0.1), vote(capitals > 0.3), vote(lonely > 0.1), vote(echoes > 0.1),
        vote(len(set(words)) / some < 0.15 and len(words) >= 20),
        vote(wordy < 2 or wordy > 14 or max(1, letters) / max(1, len(text)) < 0.6),
        vote(common < 0.01 and len(words) >= 50, common > 0.03),
        vote(stops < 0.005 and len(words) >= 50, 0.01 < stops < 0.6),
    ])


def plain_posteriors(counts):
    """EM with a table of rates per labeller, pattern by pattern."""
    good = {p: 1 / (1 + math.exp(-sum({ql.GOOD: 1, ql.BAD: -1}.get(v, 0) for v in p))) for p in counts}
    for _ in range(100):
        sides = [{p: n * (good[p] if side else 1 - good[p]) for p, n in counts.items()} for side in (0, 1)]
        prior = [(sum(s.values()) + 1) / (sum(counts.values()) + 2) for s in sides]
        new = {}
        for p in counts:
            odds = math.log(prior[1] / prior[0])
            for i, vote in enumerate(p):
                rate = [(sum(m for q, m in s.items() if q[i] == vote) + 1) / (sum(s.values()) + 3) for s in sides]
                odds += math.log(rate[1] / rate[0])
            new[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        moved = max(abs(new[p] - good[p]) for p in counts)
        good = new
        if moved < 1e-6:
            break
    return good


def test_votes_and_posteriors_equal_plain_ones(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("text")
    hard = [None, "", " ", "A a a b", "...", "Ab.!! c,?? d", "x!!!y", "ÉÀ ß 中文 ２ ²", "end.", "end.\n", "a. b! c? D", "-- || a", "the The THE"]
    docs = docs.unionByName(spark.createDataFrame([(t,) for t in hard], "text string"))
    found = docs.select("text", ql.votes(ql.F.col("text")).alias("votes")).collect()
    assert [(r.text, r.votes) for r in found if r.votes != plain_votes(r.text)] == []
    counts = Counter(r.votes for r in found)
    want, got = plain_posteriors(counts), ql.label_model(dict(counts))
    assert len(counts) > 10 and all(abs(got[p] - want[p]) < 1e-6 for p in counts)


def test_terms_equal_plain_ones(spark):
    texts = ["The the CAT2 ate 12 Ǆx.", "", None, "a  b\ta", "ÀB cD 中A A"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", ql.features(ql.F.col("text")).alias("terms")).collect()
    for r in found:
        kind = lambda c: "A" if unicodedata.category(c) == "Lu" else "a" if c.isalpha() else "0" if c in "0123456789" else c
        words = (r.text or "").split()
        shapes = [" " + "".join(k if k not in "Aa0" else k for k, _ in itertools.groupby(map(kind, w), lambda k: k)) for w in words]
        lower = [w.lower() for w in words]
        last = [" new"] if lower else []
        marks = [" again" if a == b else " new" for a, b in zip(lower, lower[1:])]
        assert r.terms[: 2 * len(words)] == shapes + lower and r.terms[2 * len(words) :] == marks + last


def test_quality_labels(spark):
    """The labels are never read by the classifier; they only judge it."""
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    rows = {r.doc_id: r for r in ql.quality(docs, ql.fit(docs)).collect()}
    judged = [(rows[r.doc_id].keep, r.quality) for r in read(spark, "/root/testdata/sf0.1", "labels").collect()]
    kept = np.mean([k for k, q in judged if q])
    dropped = np.mean([not k for k, q in judged if not q])
    print("good kept", kept, "bad dropped", dropped)
    assert kept > 0.97 and dropped > 0.8
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in rows.values())


def test_edges(spark):
    prose = "The house of the old man is by the sea, and it was cold for days. He had not been there in years."
    rows = [(i, f"{prose} Day {i} was for the sea.", 1.0) for i in range(60)]
    rows += [(100 + i, f"BUY!! NOW!! WIN!! CASH!! {i}!! GO!! GO!! GO!!", 0.0) for i in range(60)]
    rows += [(500, None, 1.0), (501, "", 0.5), (None, prose, None), (0, prose, 1.0), (502, "word " * 50_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = ql.quality(docs, ql.fit(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and 0 < r.doc_id < 160:
            assert r.keep == (r.doc_id < 60)
    assert ql.quality(docs.limit(0), ql.fit(docs.limit(0))).collect() == []


def test_rare_junk_is_found(spark):
    """Ten junk texts among 20 000 clean ones, 0.05 %: the scorer is fitted all the same."""
    prose = "The house of the old man is by the sea, and it was cold for days. He had not been there in years."
    rows = [(i, f"{prose} Day {i} was for the sea.") for i in range(20_000)]
    rows += [(50_000 + i, f"BUY!! NOW!! WIN!! CASH!! {i}!! GO!! GO!! GO!!") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ql.quality(docs, ql.fit(docs)).groupBy("keep").agg({"doc_id": "min", "*": "count"}).collect()
    assert {r.keep: (r["min(doc_id)"], r["count(1)"]) for r in found} == {1: (0, 20_000), 0: (50_000, 10)}
