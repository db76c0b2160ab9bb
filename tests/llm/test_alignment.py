from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricetide.llm import alignment as al
from pricetide.llm.catalog import TOKENIZERS, op13_token_alignment

SF_DIR = "/root/testdata/sf0.001"
A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


class Plain:
    """Alignment byte by byte, with the libraries' own readers of both files."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in a.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        told = (" " + text).encode()
        same = text and all(b"".join(t for _, t in side) == told for side in (a, b))
        return (a, b) if same else ([], [])

    def aligned(self, text):
        a, b = self.tokens(text or "")
        owner = [[k for k, (_, t) in enumerate(side) for _ in t] for side in (a, b)]
        links = sorted(set(zip(*owner)))
        ends = []
        for side in (a, b):
            at, found = 0, set()
            for _, t in side:
                at += len(t)
                found.add(at)
            ends.append(found)
        groups, place = [], [0, 0]
        offset = [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            parts = []
            for s, side in enumerate((a, b)):
                own = []
                while place[s] < len(side) and offset[s] < cut:
                    own.append(side[place[s]][0])
                    offset[s] += len(side[place[s]][1])
                    place[s] += 1
                parts.append(own)
            groups.append(parts)
        return [i for i, _ in a], [i for i, _ in b], links, groups

    def rows(self, texts):
        found = [self.aligned(text) for text in texts]
        count = Counter((a[i], b[j]) for a, b, links, _ in found for i, j in links)
        most: Counter = Counter()
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        out = []
        for a, b, links, groups in found:
            told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
            counts = [(count[a[i], b[j]], b[j]) for i, j in links]
            out.append(
                {
                    "n_a": len(a),
                    "n_b": len(b),
                    "n_groups": len(groups),
                    "n_links": len(links),
                    "n_best": sum(n == most[i] for n, i in counts),
                    "count_sum": sum(n for n, _ in counts),
                    "n_group_links": sum(len(x) * len(y) for x, y in groups),
                    "groups": told,
                }
            )
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


HARD = [
    None,
    "",
    " ",
    "a",
    "<|endoftext|> <s></s><unk> [INST]",
    "▁ is a mark",
    "naïve café — “quotes” 中文字 한국어 עברית",
    "🙂👩‍👩‍👧‍👦 \U0001f3f4\U000e0067 \x00\x01\x7f",
    "tabs\tand\r\n\r\nlines   and    spaces    ",
    "x" * 20_000,
    " " * 5000,
    "1234567890" * 500 + "!?" * 500,
]


def test_query_equals_byte_by_byte(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = plain.rows([d.text for d in docs])
    got = {r.doc_id: r for r in op13_token_alignment(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        row = got[d.doc_id].asDict()
        digest = hashlib.sha256(w["groups"].encode()).hexdigest() if w["groups"] else ""
        assert row == {k: v for k, v in w.items() if k != "groups"} | {"doc_id": d.doc_id, "groups_sha256": digest}


@pytest.mark.parametrize("most_pairs", [1 << 19, 40, 0])
def test_edges(spark, plain, most_pairs):
    """Hard, NULL, repeated and long texts, repeated and NULL ids, other columns; counts that travel or are joined."""
    texts = [*HARD, HARD[6], HARD[6]]
    ids = [None if i == 3 else i % 11 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, groups string").repartition(3)
    got = [r.asDict() for r in al.align(docs, A, B, most_pairs=most_pairs).collect()]
    want = [w | {"doc_id": i} for i, w in zip(ids, plain.rows(texts))]
    order = lambda r: (str(r["doc_id"]), r["groups"], r["n_a"])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(w["n_links"] == 0 for w in want) == 3
    assert al.align(docs.limit(0), A, B, most_pairs=most_pairs).count() == 0


def test_products_equal_dense_ones(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(al, "BLOCK_ENTRIES", 7)
    for _ in range(60):
        n, k, m = (rng.randrange(1, 9) for _ in range(3))
        dense = [np.array([[rng.random() < 0.4 for _ in range(w)] for _ in range(h)]) for h, w in ((n, k), (k, m))]
        sparse = []
        for d in dense:
            starts = np.concatenate([[0], np.cumsum(d.sum(1))])
            sparse.append(al.Csr(starts, np.nonzero(d)[1], d.shape[1]))
        want = dense[0].astype(int) @ dense[1].astype(int)
        got = np.zeros_like(want)
        for row, column, value in sparse[0].product(sparse[1]):
            got[row, column] += value
        assert (got == want).all() and (sparse[0].row_costs(sparse[1]) == want.sum(1)).all()
        back = sparse[0].transposed()
        assert (np.array([[j in back.columns[back.starts[i] : back.starts[i + 1]] for j in range(n)] for i in range(k)]) == dense[0].T).all()


def test_group_links_are_pairs_of_a_group(plain):
    with open(A, "rb") as a, open(B, "rb") as b:
        own = al.Tokenizers(a.read(), b.read())
    texts = HARD[4:9]
    found = al.Aligned.of(own, *own.encode(texts))
    pairs = {(i, j) for a, b, _ in found.group_links() for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i, g in enumerate(found.a_group) for j, h in enumerate(found.b_group) if g == h}
    assert pairs == want and found.group_links_per_text().sum() == len(want)
    assert set(zip(found.link_a.tolist(), found.link_b.tolist())) <= want


def test_other_files_are_refused():
    with open(f"{TOKENIZERS}/word_bpe_49k.json", "rb") as file, pytest.raises(ValueError):
        al.byte_level_ranks(file.read())
