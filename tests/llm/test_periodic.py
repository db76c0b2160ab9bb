from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

from pricetide.llm import periodic as pr
from pricetide.llm.catalog import op11_periodic_runs

SF_DIR = "/root/testdata/sf0.001"


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every lag of every place; of equal stretches the least period."""
    found, n = {}, len(words)
    for lag in range(1, n // 3 + 1):
        at = 0
        while at + lag < n:
            start = at
            while at + lag < n and words[at] == words[at + lag]:
                at += 1
            length = at - start + lag
            if at > start and length >= max(24, 3 * lag):
                found.setdefault((start, length), lag)
            at += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng: random.Random) -> list[bytes]:
    """Noise and repeated units, some of which consist of repeats themselves, over small and large vocabularies."""
    words: list[bytes] = []
    word = lambda: b"w%d" % rng.randrange(rng.choice([2, 3, 50]))
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.4:
            words += [word() for _ in range(rng.randrange(80))]
            continue
        unit = [word() for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 12, 13, 18, 19, 27, 28, 40, 61, 90, 130]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(1, 4) + [word() for _ in range(rng.randrange(3))]
        words += (unit * 8)[: int(len(unit) * rng.choice([2, 2.5, 2.9, 3, 3.1, 3.5, 4, 6]))]
    return words


def test_runs_equal_all_lags():
    rng = random.Random(3)
    total = 0
    for _ in range(150):
        texts = [made(rng) for _ in range(rng.randrange(6))]
        for words, runs in zip(texts, pr.find_runs(texts)):
            assert [tuple(r) for r in runs.tolist()] == brute(words)
            total += len(runs)
    assert total > 300


def test_every_period_is_found():
    """One run of each period at the least length, between other words; one word fewer is no run."""
    for period in [*range(1, 60), 97, 200, 333, 1000]:
        size = max(24, 3 * period)
        unit = [b"u%d" % i for i in range(period)]
        whole = [b"left"] + (unit * (size // period + 1))[:size] + [b"right"] * 2
        short = [b"left"] + (unit * (size // period + 1))[: size - 1] + [b"right"] * 2
        one, none = pr.find_runs([whole, short])
        assert one.tolist() == [[1, size, period]] and none.tolist() == []


def test_scales_cover_all_periods():
    at = pr.SHORT
    for low, high, window in pr.scales(100_000):
        assert low == at and window >= 1 and window + high - 1 <= 2 * (low + 1)
        at = high
    assert 3 * (at + 1) > 100_000


def expected(doc_id, text) -> tuple:
    words = text.encode().split() if text else []
    n, digest = len(words), zlib.crc32(str(doc_id).encode())
    g = digest // 10
    if digest % 10 == 0 and n:
        first = g % n
        period = 1 + (n - first) // (3 + g % 8)
        words = [words[i if i < first else first + (i - first) % period] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 5
    for d in docs:
        assert got[d.doc_id] == expected(d.doc_id, d.text)


def test_edges(spark):
    """NULLs, empty and very long texts, ties, repeated rows and ids, other columns, an empty table."""
    long = " ".join(f"x{i % 40_000}" for i in range(120_000))
    tie = " ".join(["a"] * 24 + ["-", "="] + ["b"] * 24)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (5, long), (6, tie), (6, tie), (7, "ä ö\x85 " * 25)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, runs string")
    found = pr.periodic_runs(docs)
    by = {}
    for r in pr.run_digests(found).collect():
        by.setdefault(r.doc_id, []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    for key in (1, 2, 3):
        (r,) = by[key]
        assert (r.n_runs, r.start, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (0, None, None, empty, empty)
    assert tuple(by[None][0][1:6]) == (1, 0, 30, 1, 30_000)
    assert tuple(by[5][0][1:6]) == (1, 0, 120_000, 40_000, 3000)
    assert [tuple(r[1:6]) for r in by[6]] == [(2, 0, 24, 1, 24_000)] * 2
    assert tuple(by[7][0][1:6]) == (1, 0, 25, 1, 25_000)
    texts = {r.doc_id: r.collapsed for r in found.collect()}
    assert texts[6] == "a - = b" and texts[7] == "ä ö\x85"
    assert pr.run_digests(pr.periodic_runs(docs.limit(0))).count() == 0
