"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches, written

#: Labelled rows that the classifier is fitted on, at most, drawn by a digest of the id.
MOST_EXAMPLES = 4_000
#: Examples that vote, vectors of a block of the index, frequent terms that are kept for all vectors, and bins of the
#: calibration.
NEIGHBOURS, BLOCK, DENSE, BINS = 128, 2048, 256, 50
#: Texts that are searched together, and characters whose words are held at a time.
GROUP, CHUNK_CHARS = 16, 1 << 18
#: A term leans to a label as far as its log odds ratio exceeds so many of its standard errors.
ERRORS = 2.0
#: Weight of a neighbour that shares no term which leans to a label, next to those that do.
PLAIN_VOTE = 1e-3
#: Cosines that differ by less are equal: weights are single-precision numbers.
TIE = 1e-6
#: Texts whose scores a task remembers.
REMEMBERED = 1 << 14

_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    """The words of a text in lower case; a word is a run of letters."""
    return _WORDS.findall(text.lower()) if text else []


def digests(words: list[str]) -> np.ndarray:
    found = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) for word in words)
    return np.fromiter(found, np.uint64, len(words)).view(np.int64)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def _numbered(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the numbers of its words among the words of all of them, and the digests of these."""
    own = [terms(text) for text in texts]
    numbers, words = pd.factorize(np.array([*chain.from_iterable(own), ""], dtype=object))
    return np.split(numbers[:-1], np.cumsum([len(w) for w in own])[:-1]) if own else [], digests(words)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to CHUNK_CHARS together, or of one text more: their words are held at a time."""
    size = np.cumsum([len(text or "") for text in texts]) // CHUNK_CHARS
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
    return ((low, high) for low, high in zip(cuts, cuts[1:]) if low < high)


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Digests of the words of each text, rising, and how often it has them."""
    for low, high in _chunks(texts):
        own, digest = _numbered(texts[low:high])
        for numbers in own:
            yield np.unique(digest[numbers], return_counts=True)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), then those of the next range."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


@dataclass
class Postings:
    """An inverted index: the members that have a term, and their weights, term by term."""

    starts: np.ndarray
    members: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(term: np.ndarray, member: np.ndarray, weight: np.ndarray, terms_: int) -> Postings:
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms_))]).astype(np.int32)
        return Postings(starts, member[order].astype(np.int32), weight[order])

    def products(self, owner: np.ndarray, term: np.ndarray, x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Products [text, member] of texts with all members; the texts have these terms, with weights x."""
        first = self.starts[term]
        sizes = self.starts[term + 1] - first
        at = _ranges(first, sizes)
        cell = np.repeat(owner * shape[1], sizes) + self.members[at]
        return np.bincount(cell, self.weights[at] * np.repeat(x, sizes), shape[0] * shape[1]).reshape(shape)


@dataclass
class Index:
    """Vectors of the examples, equal ones once, in blocks of vectors whose most frequent words are alike."""

    vocabulary: np.ndarray  # digests of the terms, rising
    idf: np.ndarray
    lean: np.ndarray  # of the terms: the squared sure part of the log odds ratio of the labels, 0 for most
    ids: np.ndarray  # lowest id of the examples with this vector
    toxic: np.ndarray  # their number with label 1
    sizes: np.ndarray  # their number
    firsts: np.ndarray  # of the vectors in the next two
    found: np.ndarray  # terms
    counts: np.ndarray
    plain_rate: float  # share of toxic examples among those without a term
    bounds: np.ndarray | None = None  # calibration: votes up to bounds[i] mean rates[i]
    rates: np.ndarray | None = None
    seen: dict = field(default_factory=dict)  # scores of vectors met before, REMEMBERED at most
    blocks: list[Postings] | None = None

    def invert(self) -> Index:
        """Makes the indexes.

        `dense` holds the weights [term, vector] of the DENSE most frequent terms. All others are in `blocks`, an inverted
        index for each BLOCK vectors; `largest` is the highest weight of each term in each block, 0 for frequent ones.
        """
        if self.blocks is not None:
            return self
        vectors = len(self.ids)
        member = np.repeat(np.arange(vectors), np.diff(self.firsts))
        weight = (1 + np.log(self.counts)) * self.idf[self.found]
        lengths = np.sqrt(np.bincount(member, weight**2, vectors))
        self.weights = (weight / np.maximum(lengths, 1e-12)[member]).astype(np.float32)
        df = np.bincount(self.found, minlength=len(self.idf))
        self.place = np.full(len(self.idf), -1, np.int64)
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        self.place[frequent] = np.arange(len(frequent))
        often = self.place[self.found] >= 0
        self.dense = np.zeros((len(frequent), vectors), np.float32)
        self.dense[self.place[self.found[often]], member[often]] = self.weights[often]
        found, member, weight = self.found[~often], member[~often], self.weights[~often]
        self.blocks, self.largest = [], np.zeros((len(self.idf), -(-vectors // BLOCK)), np.float32)
        cuts = np.searchsorted(member, np.arange(0, vectors + BLOCK, BLOCK))
        for i, (low, high) in enumerate(zip(cuts[: self.largest.shape[1]], cuts[1:])):
            self.blocks.append(Postings.of(found[low:high], member[low:high] - i * BLOCK, weight[low:high], len(self.idf)))
            np.maximum.at(self.largest[:, i], found[low:high], weight[low:high])
        leans = self.lean[self.found] > 0
        whole = np.repeat(np.arange(vectors), np.diff(self.firsts))
        self.leaning = Postings.of(self.found[leans], whole[leans], self.weights[leans], len(self.idf))
        return self

    def vector(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(n)) * self.idf[term]
        return weight / max(float(np.sqrt(weight @ weight)), 1e-12)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the vectors of the NEIGHBOURS nearest examples, with all that tie with the last, and their
        cosines, falling.

        Frequent terms are one product of matrices. A block is looked at for those texts only that it allows a cosine as
        high as their nearest so far: the highest sum of its frequent terms, and the largest weights of the others. What
        is left out holds none of the nearest. `without` has a vector for each text of which one example does not count.
        """
        without = [-1] * len(texts) if without is None else without
        owner = np.repeat(np.arange(len(texts)), [len(term) for term, _ in texts])
        term = np.concatenate([np.empty(0, np.int64), *(term for term, _ in texts)])
        x = np.concatenate([np.empty(0), *(self.vector(*text) for text in texts)])
        often = self.place[term] >= 0
        query = np.zeros((len(texts), len(self.dense)), np.float32)
        query[owner[often], self.place[term[often]]] = x[often]
        common = query @ self.dense
        owner, term, x = owner[~often], term[~often], x[~often]
        found, least = [(np.empty(0, np.int64), np.empty(0))] * len(texts), np.zeros(len(texts))
        allowed = [
            common[:, i * BLOCK : (i + 1) * BLOCK].max(axis=1) + np.bincount(owner, x * self.largest[term, i], len(texts))
            for i in range(len(self.blocks))
        ]
        for i in sorted(range(len(self.blocks)), key=lambda i: -allowed[i].sum()):
            active = allowed[i] >= np.maximum(least - 2 * TIE, 1e-9)
            rows = np.flatnonzero(active)
            if not len(rows):
                continue
            part, chosen = common[rows, i * BLOCK : (i + 1) * BLOCK], active[owner]
            place = np.cumsum(active) - 1
            sums = self.blocks[i].products(place[owner[chosen]], term[chosen], x[chosen], part.shape) + part
            for row, scores in zip(rows.tolist(), sums):
                found[row], least[row] = self._merged(found[row], scores, i * BLOCK, least[row], without[row])
        out = []
        for (at, cosine), low, own in zip(found, least.tolist(), without):
            near = (cosine >= low - TIE) & (self.sizes[at] - (at == own) > 0)
            at, cosine = at[near], cosine[near]
            order = np.lexsort((at, -cosine))
            out.append((at[order], cosine[order]))
        return out

    def _merged(
        self, found: tuple[np.ndarray, np.ndarray], scores: np.ndarray, first: int, least: float, without: int
    ) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        """The nearest vectors so far and those of a block, and the cosine of the last of the nearest examples."""
        floor = max(least, float(np.partition(scores, -NEIGHBOURS - 1)[-NEIGHBOURS - 1]) if len(scores) > NEIGHBOURS else 0.0)
        hit = np.flatnonzero(scores >= max(floor - 2 * TIE, 1e-9))
        at, cosine = np.concatenate([found[0], hit + first]), np.concatenate([found[1], scores[hit]])
        size = self.sizes[at] - (at == without)
        if size.sum() >= NEIGHBOURS:
            order = np.argsort(-cosine, kind="stable")
            least = float(cosine[order[np.searchsorted(np.cumsum(size[order]), NEIGHBOURS)]])
            kept = cosine >= least - 2 * TIE
            at, cosine = at[kept], cosine[kept]
        return (at, cosine), least

    def votes(
        self, texts: list[tuple[np.ndarray, np.ndarray]], own: list[tuple[int, int]] | None = None
    ) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each text the distance-weighted share of toxic neighbours (None without any), and their vectors.

        A neighbour weighs its nearness times the share of its cosine that comes from leaning terms. All examples of
        a vector vote. `own` has a vector for each text, and the label of one of its examples that does not.
        """
        out = []
        for i, (at, cosine) in enumerate(self.nearest(texts, [vector for vector, _ in own] if own else None)):
            if not len(at):
                out.append((None, at, cosine))
                continue
            term, n = texts[i]
            leans = np.flatnonzero(self.lean[term] > 0)
            products = (self.vector(term, n) * self.lean[term])[leans]
            share = self.leaning.products(np.zeros(len(leans), np.int64), term[leans], products, (1, len(self.ids)))[0, at] / cosine
            weight = (PLAIN_VOTE + share) / (1.05 - np.minimum(cosine, 1.0))
            size, toxic = self.sizes[at].astype(float), self.toxic[at].astype(float)
            if own:
                size, toxic = size - (at == own[i][0]), toxic - (at == own[i][0]) * own[i][1]
            out.append((float((weight @ toxic) / (weight @ size)), at, cosine))
        return out

    def counted(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms of the vocabulary in each text, rising, and how often it has them."""
        for low, high in _chunks(texts):
            own, digest = _numbered(texts[low:high])
            number = np.searchsorted(self.vocabulary, digest)
            number[number == len(self.vocabulary)] = 0
            known = self.vocabulary[number] == digest if len(self.vocabulary) else np.zeros(len(digest), bool)
            number = np.where(known, number, -1)
            for numbers in own:
                found = number[numbers]
                yield np.unique(found[found >= 0], return_counts=True)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated vote of each text, and its three nearest examples with their cosines."""
        counted = list(self.counted(texts))
        for low in range(0, len(counted), GROUP):
            part = counted[low : low + GROUP]
            keys = [blake2b(term.tobytes() + n.tobytes(), digest_size=16).digest() for term, n in part]
            fresh = {key: own for key, own in zip(keys, part) if key not in self.seen}
            told = {key: self.seen[key] for key in keys if key in self.seen}
            for key, (vote, at, cosine) in zip(fresh, self.votes(list(fresh.values()))):
                share = self.plain_rate if vote is None else float(self.rates[min(np.searchsorted(self.bounds, vote), len(self.rates) - 1)])
                told[key] = share, self.ids[at[:3]], cosine[:3]
                if len(self.seen) < REMEMBERED:
                    self.seen[key] = told[key]
            yield from (told[key] for key in keys)


def _calibration(votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Toxic share of equally filled bins of the votes, made rising by pooling neighbours."""
    votes = sorted(votes)
    bins: list[list[float]] = []  # toxic, all, highest vote
    size = max(1, -(-len(votes) // BINS))
    for start in range(0, len(votes), size):
        part = votes[start : start + size]
        bins.append([sum(label for _, label in part), len(part), part[-1][0]])
        while len(bins) > 1 and (
            bins[-2][2] >= bins[-1][2] or bins[-2][0] * bins[-1][1] >= bins[-1][0] * bins[-2][1]
        ):
            last = bins.pop()
            bins[-1] = [bins[-1][0] + last[0], bins[-1][1] + last[1], last[2]]
    if not bins:
        return np.array([1.0]), np.array([0.0])
    return np.array([b[2] for b in bins]), np.array([(b[0] + 0.25) / (b[1] + 0.5) for b in bins])


def _chosen(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Ids and labels of the rows to learn from: never held-out ones, MOST_EXAMPLES at most."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    return written(rows.orderBy(F.xxhash64("id"), "id").limit(MOST_EXAMPLES), "chosen-labels")


def _entries(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per different vector of the examples: (id, size, toxic, terms, counts), a written table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(term_counts(batch["text"].tolist()))
            yield batch[["id", "label"]].assign(terms=[t for t, _ in found], counts=[n.astype(np.int32) for _, n in found])

    # MOST_EXAMPLES ids at most; an id with several texts takes the greatest.
    own = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    vectors = written(own.mapInPandas(count, "id long, label int, terms array<long>, counts array<int>"), "labelled-vectors")
    # The count of a single term is no matter.
    counts = F.when(F.size("terms") > 1, F.col("counts")).otherwise(F.transform("counts", lambda _: F.lit(1)))
    groups = vectors.withColumn("counts", counts).groupBy("terms", "counts")
    return written(groups.agg(F.min("id").alias("id"), F.count("*").alias("size"), F.sum("label").alias("toxic")), "vectors")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Index:
    """The index of labelled examples.

    All words of the examples are its terms. A term weighs its inverse document frequency, counted over all documents.
    How much it leans to a label (what is sure of its log odds ratio, with pseudo-counts in the labels' proportions) has
    a say in the votes only. Votes are calibrated on the examples, each without itself. The driver holds at most
    MOST_EXAMPLES sparse vectors and a few numbers for each of their terms, as packed arrays.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    entries = _entries(texts, _chosen(labels, id_col, label_col))
    sums = entries.select(F.explode("terms").alias("term"), "size", "toxic").groupBy("term")
    sums = sums.agg(F.sum("size").alias("n"), F.sum("toxic").alias("toxic")).toArrow().sort_by("term")
    vocabulary = sums["term"].to_numpy()
    n, toxic = sums["n"].to_numpy().astype(float), sums["toxic"].to_numpy().astype(float)
    known = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(known.value, *[None] * 8, 0.0)
        seen = np.zeros(len(known.value) + 1, np.int64)  # the last one counts documents
        for batch in batches:
            for term, _ in own.counted(batch["text"].tolist()):
                seen[term] += 1
            seen[-1] += len(batch)
        met = np.flatnonzero(seen)
        yield pd.DataFrame({"term": met, "df": seen[met]})

    rows = texts.select("text").mapInPandas(frequencies, "term int, df long")
    rows = rows.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    known.destroy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5))

    held = entries.toArrow().combine_chunks()
    ids, size, marked = (held[name].to_numpy() for name in ("id", "size", "toxic"))
    lengths = _lengths(held["terms"])
    found = np.searchsorted(vocabulary, _values(held["terms"]))
    counts = _values(held["counts"])
    total, positive = max(int(size.sum()), 1), int(marked.sum())
    share = positive / total
    odds = np.log((toxic + share) / max(positive, 0.5)) - np.log((n - toxic + 1 - share) / max(total - positive, 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (n - toxic + 0.5))
    order = _alike(ids, lengths, found, n)
    first = np.cumsum(lengths) - lengths
    part = _ranges(first[order], lengths[order])
    with_terms = order[lengths[order] > 0]  # those without any come last
    plain = lengths == 0
    index = Index(
        vocabulary, idf, (np.maximum(np.abs(odds) - ERRORS * error, 0) ** 2).astype(np.float32), ids[with_terms], marked[with_terms], size[with_terms],
        np.concatenate([[0], np.cumsum(lengths[with_terms])]), found[part].astype(np.int32), counts[part].astype(np.int32),
        (float(marked[plain].sum()) + 0.5) / (float(size[plain].sum()) + 10.0),
    )
    del held, found, counts, part
    sent = spark.sparkContext.broadcast(_sent(index))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _received(sent.value)
        for batch in batches:
            sides = [(at, label, int(own.toxic[at] if label else own.sizes[at] - own.toxic[at])) for at in batch["id"].tolist() for label in (0, 1)]
            sides, out = [side for side in sides if side[2]], []
            for first in range(0, len(sides), GROUP):
                part = sides[first : first + GROUP]
                texts = [(own.found[own.firsts[at] : own.firsts[at + 1]].astype(np.int64), own.counts[own.firsts[at] : own.firsts[at + 1]]) for at, _, _ in part]
                told = own.votes(texts, [(at, label) for at, label, _ in part])
                out += [(vote, label, n) for (vote, _, _), (_, label, n) in zip(told, part) if vote is not None]
            yield pd.DataFrame(out, columns=["vote", "label", "n"]).astype({"vote": float, "label": "int64", "n": "int64"})

    vectors = spark.range(len(index.ids)).repartition(max(1, len(index.ids) // 500))
    votes = vectors.mapInPandas(vote, "vote double, label long, n long").collect()  # two for each vector at most
    index.bounds, index.rates = _calibration([(r.vote, r.label) for r in votes for _ in range(r.n)])
    sent.destroy()
    del sent, vocabulary, sums, rows, votes
    pa.default_memory_pool().release_unused()  # Arrow would keep what it has freed, beside the JVM's memory
    return index


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in column.chunks)])


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in column.chunks)])


def _alike(ids: np.ndarray, lengths: np.ndarray, found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An order of the vectors by their three most frequent terms, so that blocks hold texts of one kind or language."""
    owner = np.repeat(np.arange(len(ids)), lengths)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    order = np.lexsort((rank[found], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = np.full((len(ids), 3), len(n), np.int64)
    top = place < 3
    keys[owner[top], place[top]] = rank[found[order]][top]
    return np.lexsort((ids, keys[:, 2], keys[:, 1], keys[:, 0]))


#: Arrays that travel packed.
_PACKED = ("vocabulary", "idf", "lean", "ids", "toxic", "sizes", "firsts", "found", "counts")


def _sent(index: Index) -> dict:
    """The vectors as packed plain values, which tasks can read without this package."""
    plain = {"plain_rate": index.plain_rate, "bounds": index.bounds, "rates": index.rates}
    for name in _PACKED:
        array = getattr(index, name)
        plain[name] = str(array.dtype), array.nbytes, pa.compress(array.tobytes(), "zstd", asbytes=True)
    return plain


def _received(values: dict) -> Index:
    """The index of packed values, made once in each worker process: a broadcast value stays there."""
    if "index" not in values:
        wide = {n: np.frombuffer(pa.decompress(p, size, "zstd", asbytes=True), kind) for n, (kind, size, p) in ((n, values[n]) for n in _PACKED)}
        values["index"] = Index(**{n: v for n, v in values.items() if n not in _PACKED} | wide).invert()
    return values["index"]


def toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, neighbours, cosines), one per row of `docs`.

    `score` (0 to 1) is the calibrated vote of the nearest labelled examples, `neighbours` the three nearest
    ones; of examples with equal vectors the lowest id. Words that no example has are in no vector. A text without any
    term of the examples, an empty and a NULL one get the share of toxic examples among examples without any term. A
    NULL id is not held out; repeated ids and texts are rows like others; a long text is read whole; other columns are
    not looked at. Texts are scored where they are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_sent(index))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _received(sent.value)
        for batch in batches:
            rows = []
            for key, (score, near, cosine) in zip(batch["id"].astype("Int64"), own.scores(batch["text"].tolist())):
                out = not pd.isna(key) and is_held_out(int(key))
                rows.append((key, out, score, int(score >= 0.5), near, cosine))
            names = ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"
    return texts.mapInPandas(run, schema)


def remove_toxic(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score 0.5 or more; all columns stay, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(_sent(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _received(sent.value)
        for batch in batches:
            clean = [score < 0.5 for score, _, _ in own.scores(batch.column(text_col).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
