from __future__ import annotations

import hashlib
from functools import reduce
from operator import xor

import xxhash

from pricetide.llm import fingerprints as fp
from pricetide.llm.common import read, tokens

SF_DIR = "/root/testdata/sf0.001"


def edits(rows):
    """doc id -> (edited text, next id)."""
    order = sorted(rows, reverse=True)
    out = {}
    for i, key in enumerate(order):
        following = order[(i + 1) % len(order)]
        text, other = rows[key] or "", rows[following] or ""
        half = len(text) // 2
        out[key] = (text[: len(text) - half] + other[:half], following)
    return out


def spark_hash(text, seed=42):
    return xxhash.xxh64_intdigest(text, seed)


def by_hand(text, band):
    """The whole band's digest and the subsets', from first principles."""
    terms = {t.decode() for t in tokens(text)}
    kept = terms & band
    subsets = []
    for draw in range(fp.DRAWS):
        for depth in fp.DENSITIES:
            # xxhash64 of several columns: the digest of one is the seed of the next.
            inside = [t for t in kept if spark_hash(f"draw {draw}", spark_hash(t)) % (1 << depth) == 0]
            subsets.append(reduce(xor, [spark_hash(t) & 0xFFFF for t in inside]) if inside else -1)
    mark, shown = ("", kept) if kept else ("~", terms)
    whole = f"{mark}{reduce(xor, map(spark_hash, shown)):016x}" if shown else ""
    return whole, subsets


def as_text(whole, subsets):
    return whole + ":" + "".join(fp.EMPTY if s < 0 else f"{s:04x}" for s in subsets)


def alike(x, y):
    if x == y:
        return 1.0
    shown = [(a, b) for a, b in zip(x[1], y[1]) if a >= 0 or b >= 0]
    return sum(a == b for a, b in shown) / len(shown) if shown else 0.0


def test_against_brute_force(spark):
    docs = read(spark, SF_DIR, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    df = {}
    for text in texts.values():
        for term in {t.decode() for t in tokens(text)}:
            df[term] = df.get(term, 0) + 1
    low, high = max(2, -(-len(texts) // 500)), len(texts) / 20
    band = {t for t, n in df.items() if low <= n <= high}
    changed = edits(texts)
    found = fp.fingerprint_edits(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for row in found:
        text, following = changed[row.doc_id]
        own, new, after = (by_hand(t, band) for t in (texts[row.doc_id], text, texts[following]))
        assert row.n_chars == len(texts[row.doc_id] or "")
        assert row.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (as_text(*own), as_text(*new))
        assert abs(row.near_edited - alike(own, new)) < 1e-12 and abs(row.near_next - alike(own, after)) < 1e-12


def test_edits_are_nearer_than_neighbours(spark):
    rows = fp.fingerprint_edits(read(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert sum(r.near_edited for r in rows) > 4 * sum(r.near_next for r in rows)
    nearer = sum((r.near_edited > r.near_next) + 0.5 * (r.near_edited == r.near_next) for r in rows)
    assert nearer > 0.9 * len(rows)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_nulls_ties_and_ranges(spark, monkeypatch):
    """Many small ranges give the same successors as one."""
    rows = [(i, f"w{i} w{i // 2} w{i // 3} common") for i in range(0, 60, 3)] + [(100, None), (101, ""), (102, "ß𝄞é")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, range string")
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, (t, _) in edits(dict(rows)).items()}
    for size in (5_000, 2):
        monkeypatch.setattr(fp, "RANGE_ROWS", size)
        found = fp.fingerprint_edits(frame).collect()
        assert {r.doc_id: r.edited_sha256 for r in found} == want
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints[100] == prints[101]
    same = frame.unionByName(frame).unionByName(frame.selectExpr("CAST(NULL AS long) doc_id", "text", "id", "range"))
    assert fp.fingerprint_edits(same).count() == 3 * len(rows)
    assert fp.fingerprint_edits(frame.limit(0)).count() == 0
    alone = fp.fingerprint_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b ").hexdigest() or alone.near_next == 1.0
