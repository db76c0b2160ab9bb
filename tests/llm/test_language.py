from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from pricetide.llm import language as lg
from pricetide.llm.common import read

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def predicted(spark):
    docs = read(spark, SF_DIR, "documents")
    model = lg.fit(docs)
    return model, {r.doc_id: r for r in lg.predict(docs, model).collect()}


def test_held_out_languages(predicted, spark):
    model, rows = predicted
    docs = read(spark, SF_DIR, "documents").select("doc_id", "lang").collect()
    assert model.languages == sorted({d.lang for d in docs}) and len(rows) == len(docs)
    held = [(rows[d.doc_id], d.lang) for d in docs if rows[d.doc_id].held_out]
    assert len(held) > 2000
    right = np.array([r.lang_pred == lang for r, lang in held])
    sure = np.array([r.score for r, _ in held])
    print("accuracy", right.mean(), "mean score", sure.mean(), "temperature", model.temperature)
    assert right.mean() > 0.995 and abs(sure.mean() - right.mean()) < 0.01
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    share = (model.weights != 0).mean()
    assert 0 < share < 0.3  # the net leaves most weights at zero


def test_held_out_rows_are_never_learnt(predicted, spark):
    model, _ = predicted
    held = lg.is_held_out(lg.F.col("doc_id"))
    turned = read(spark, SF_DIR, "documents").withColumn("lang", lg.F.when(held, "xx").otherwise(lg.F.col("lang")))
    turned = turned.withColumn("text", lg.F.when(held, "zzz").otherwise(lg.F.col("text"))).withColumn("source", lg.F.lit("s"))
    again = lg.fit(turned)
    assert again.languages == model.languages and again.temperature == model.temperature
    assert (again.idf == model.idf).all() and (again.weights == model.weights).all()


def plain_grams(text: str) -> Counter:
    """n-grams of the words in lower case, as strings."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    line = " " + " ".join(letters.split()) + " "
    return Counter(line[i : i + n] for n in range(1, lg.LONGEST + 1) for i in range(len(line) - n + 1)) if line.strip() else Counter()


def test_ngrams_equal_plain_ones():
    fold = lg.folding()
    texts = ["Ab ab", "", None, "  12 ", "Élan, ÉLAN!!", "x", "a" * 5000, "ß İ ﬁ 中文", "á b", " tail ", "12 a 3"]
    found = list(lg.ngrams(texts, fold))
    assert len(found) == len(texts)
    for text, (at, n) in zip(texts, found):
        want: Counter = Counter()
        for gram, count in plain_grams(text or "").items():
            want[int(lg._hashed(np.array([ord(c) for c in gram], np.uint32), len(gram))[0])] += count
        assert dict(zip(at.tolist(), n.tolist())) == dict(want)
    assert list(lg.ngrams([], fold)) == []


def test_ftrl_equals_plain_steps():
    rng = np.random.default_rng(4)
    z, n = rng.normal(size=(6, 3)), rng.random((6, 3))
    plain_z, plain_n = z.copy(), n.copy()
    rows = [(int(rng.integers(3)), np.sort(rng.choice(6, 3, replace=False)), rng.random(3)) for _ in range(20)]
    lg.ftrl(z, n, rows)
    for label, at, x in rows:
        w = np.zeros((6, 3))
        for i in range(6):
            for k in range(3):
                if abs(plain_z[i, k]) > lg.L1:
                    slope = (lg.BETA + plain_n[i, k] ** 0.5) / lg.ALPHA + lg.L2
                    w[i, k] = -(plain_z[i, k] - np.sign(plain_z[i, k]) * lg.L1) / slope
        raw = np.exp([sum(x[j] * w[at[j], k] for j in range(3)) for k in range(3)])
        for k in range(3):
            for j in range(3):
                g = x[j] * (raw[k] / raw.sum() - (k == label))
                sigma = ((plain_n[at[j], k] + g * g) ** 0.5 - plain_n[at[j], k] ** 0.5) / lg.ALPHA
                plain_z[at[j], k] += g - sigma * w[at[j], k]
                plain_n[at[j], k] += g * g
    assert np.allclose(z, plain_z) and np.allclose(n, plain_n)


def test_temperature():
    """Scores ten times too sure are divided by about ten; without scores nothing is."""
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(4000, 3)) * 2
    odds = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=p) for p in odds])
    assert 8 < lg.temperature(scores * 10, labels) < 12
    assert lg.temperature(np.empty((0, 3)), np.empty(0, np.int64)) == 1.0


def test_edges(spark):
    """NULLs, texts without letters, long texts, ties, repeated rows and ids, clashing columns, no labels, no rows."""
    schema = "doc_id long, text string, lang string, score double, grams string"
    words = {"xx": "kra zok wuk", "yy": "lilo meni sala", "": "12 34"}
    rows = [(i, f"{words[lang]} {words[lang]} {i}", lang) for i in range(200) for lang in ("xx", "yy")]
    rows += [(7, words["xx"], "xx")] * 500 + [(500, "", "xx"), (501, None, "yy"), (502, words["xx"], None), (503, "5", "")]
    rows += [(600, "kra " * 100_000, None), (None, words["yy"], "yy"), (602, "123 !?", None), (603, "kra zok wuk", None)]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "g") for i, t, lang in rows], schema)
    model = lg.fit(docs)
    assert model.languages == ["", "xx", "yy"]
    found = lg.predict(docs, model).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r.doc_id: r for r in found}
    for key in (500, 501, 503, 602):
        assert (by[key].lang_pred, by[key].score) == ("und", 0.0)
    assert by[600].lang_pred == by[603].lang_pred == by[502].lang_pred == "xx"
    assert by[None].lang_pred == "yy" and by[None].held_out is False
    bare = lg.fit(docs.withColumn("lang", lg.F.lit(None).cast("string")))
    assert bare.languages == [] and {r.lang_pred for r in lg.predict(docs, bare).collect()} == {"und"}
    single = lg.fit(docs.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in lg.predict(docs.where("doc_id < 200"), single).collect()} == {("xx", 1.0)}
    assert lg.predict(docs.limit(0), model).count() == 0 and lg.fit(docs.limit(0)).languages == []


def test_equally_likely_languages_go_by_name(spark):
    size = 1 << lg.BITS
    model = lg.Model(["aa", "bb"], np.ones(size), np.zeros((size + 1, 2)), 1.0)
    docs = spark.createDataFrame([(1, "any text")], "doc_id long, text string")
    assert tuple(lg.predict(docs, model).first()[2:]) == ("aa", 0.5)
