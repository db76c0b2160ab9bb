"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches, written

#: Training texts per language, at most: those with the lowest digests. Document frequencies cover all training texts.
SAMPLE_TEXTS = 3000
#: Character n-grams of 1 to LONGEST letters go to 2 ** BITS counters.
LONGEST, BITS = 3, 16
#: The samples are dealt to so many tasks, whose models are averaged after each of the rounds.
SHARDS, ROUNDS = 8, 5
#: FTRL: learning rate, its smoothing, and the elastic net's two weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: One in so many samples is kept out of the training, to fit the temperature.
CALIBRATION = 8
#: Prediction where there is nothing to read.
UNDETERMINED = "und"
#: Characters whose n-grams are made together, unless one text is longer.
CHUNK_CHARS = 1 << 18

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def folding() -> np.ndarray:
    """Lower-case letter of each letter, a space for every other code point."""
    chars = map(chr, range(0x110000))
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in chars), np.uint32, 0x110000)


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Counter of each n-gram that begins with a code."""
    size = max(0, len(codes) - n + 1)
    x = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        x += codes[i : i + size] * np.uint32(_FACTORS[i])
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(16)
    return (x >> np.uint32(32 - BITS)).astype(np.uint16 if BITS <= 16 else np.uint32)


def ngrams(texts: list[str | None], fold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its counters and their counts; none for a text without letters.

    Letters are in lower case. Everything between two words is one space, and a space is put before the first and
    after the last word, so n-grams know where words begin and end.
    """
    whole = [" " + (text or "") + " " for text in texts]
    codes = fold[np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(text) for text in whole])
    space = codes == 32
    kept = np.concatenate([[True], ~(space[1:] & space[:-1])]) if len(codes) else np.empty(0, bool)
    kept[np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(texts)]] = True  # each text has its first space
    ends = np.concatenate([[0], np.cumsum(kept)[ends - 1]]) if len(texts) else np.zeros(1, np.int64)
    codes = codes[kept]
    grams = [_hashed(codes, n) for n in range(1, LONGEST + 1)]
    for low, high in zip(ends.tolist(), ends[1:].tolist()):
        if high - low < 3:
            yield np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        own = np.concatenate([g[low : high - n] for n, g in enumerate(grams)])
        counts = np.bincount(own, minlength=1 << BITS)
        found = np.flatnonzero(counts)
        yield found, counts[found]


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of up to CHUNK_CHARS or one text more."""
    size = np.cumsum(batch["text"].str.len().fillna(0).to_numpy(np.int64)) // CHUNK_CHARS
    for _, part in batch.groupby(size, sort=False):
        yield part


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's weights: zero where the sum of gradients is within L1."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(scores: np.ndarray) -> np.ndarray:
    x = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def ftrl(z: np.ndarray, n: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass over (label, counters, values); z and n, [counter, label], are changed in place."""
    for label, at, x in rows:
        zs, ns = z[at], n[at]
        w = _weights(zs, ns)
        off = _softmax(x @ w)
        off[label] -= 1.0
        step = np.outer(x, off)
        new = ns + step * step
        z[at] = zs + step - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
        n[at] = new


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, between 1/16 and 16; 1 without scores.

    As in Platt's scaling, a label counts as (N + 1) / (N + 2) sure, so N right answers do not mean certainty.
    """
    size, kinds = scores.shape
    if not size or kinds < 2:
        return 1.0
    sure = np.full(scores.shape, 1 / (size + 2) / (kinds - 1))
    sure[np.arange(size), labels] = (size + 1) / (size + 2)
    loss = lambda t: -(sure * np.log(_softmax(scores / np.exp(t)) + 1e-300)).sum()
    low, high, ratio = -np.log(16.0), np.log(16.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):  # the loss has one valley
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """`weights` [counter, language], the last row for all texts; `idf` of the counters; the calibrated temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _values(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the counters of a text, of length 1."""
    x = (1 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _with_constant(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, 1 << BITS), np.append(x, 1.0)


def is_held_out(doc_id: Column) -> Column:
    """The contract's held-out ids: crc32 of the id as text leaves 2 when divided by 4; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """The SAMPLE_TEXTS different texts of each language with the lowest digests: (lang, digest, text), each once.

    Digests above four times the expected cut drop out before anything is ordered, and tasks keep no more than
    the sample's size each.
    """
    share = F.least(F.lit(1.0), 4.0 * SAMPLE_TEXTS / F.col("count"))
    digest = F.xxhash64("text")
    rows = rows.where("text IS NOT NULL").withColumn("digest", digest).join(F.broadcast(totals), "lang")
    rows = rows.where(F.pmod("digest", F.lit(1 << 20)) <= share * (1 << 20)).select("lang", "digest", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    cuts = rows.select("lang", "digest").distinct().withColumn("place", place).where(F.col("place") <= SAMPLE_TEXTS)
    cuts = cuts.groupBy("lang").agg(F.max("digest").alias("cut"))  # a row for each language
    rows = rows.join(F.broadcast(cuts), "lang").where("digest <= cut")
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the languages of `docs`, learnt from rows that are not held out and whose language is not NULL.

    Document frequencies are counted over all of these. The weights are learnt from up to SAMPLE_TEXTS different
    texts per language: each of SHARDS tasks runs FTRL over its samples, starting from the average of the tasks' last
    round. The driver holds a model: 2 ** BITS rows by languages. Without any such row the model knows no language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~is_held_out(F.col("id"))).select("text", "lang")
    totals = written(rows.groupBy("lang").count(), "languages")  # a row for each language
    counts = {r["lang"]: r["count"] for r in totals.collect()}
    languages = sorted(counts)
    size = 1 << BITS
    if not languages:
        return Model([], np.zeros(size), np.zeros((size + 1, 0)), 1.0)
    fold = spark.sparkContext.broadcast(folding())

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for part in _chunks(batch):
                for at, _ in ngrams(part["text"].tolist(), fold.value):
                    seen[at] += 1
        met = np.flatnonzero(seen)
        yield pd.DataFrame({"gram": met, "df": seen[met]})

    df = rows.select("text").mapInPandas(frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
    seen = np.zeros(size)
    seen[df["gram"].to_numpy()] = df["df"].to_numpy()
    idf = np.log((sum(counts.values()) + 1) / (seen + 0.5))

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(batch):
                found = [(at, _values(at, n, idf)) for at, n in ngrams(part["text"].tolist(), fold.value)]
                found = [_with_constant(at, x) for at, x in found]
                columns = {"grams": [at.astype(np.int32) for at, _ in found], "x": [x.astype(np.float32) for _, x in found]}
                yield part.drop(columns="text").assign(**columns)

    label = F.array_position(F.lit(languages), F.col("lang")) - 1
    sampled = _sampled(rows, totals).select("digest", label.cast("int").alias("label"), "text")
    schema = "digest long, label int, grams array<int>, x array<float>"
    sampled = written(sampled.mapInPandas(samples, schema), "language-samples")
    part = F.pmod(F.shiftright("digest", 20), F.lit(CALIBRATION))
    learnt = sampled.where(part > 0).withColumn("shard", F.pmod(F.shiftright("digest", 24), F.lit(SHARDS)))
    z, n = np.zeros((size + 1, len(languages))), np.zeros((size + 1, len(languages)))
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def train(shard: pd.DataFrame) -> pd.DataFrame:
            own_z, own_n = (x.copy() for x in state.value)
            shard = shard.sort_values(["digest", "label"])
            ftrl(own_z, own_n, list(zip(shard["label"], shard["grams"], shard["x"].map(lambda x: x.astype(np.float64)))))
            return pd.DataFrame({"shard": shard["shard"][:1], "z": [own_z.tobytes()], "n": [own_n.tobytes()]})

        trained = learnt.groupBy("shard").applyInPandas(train, "shard long, z binary, n binary").collect()
        trained.sort(key=lambda r: r.shard)  # sums of doubles depend on their order
        state.destroy()
        if trained:
            z = np.mean([np.frombuffer(r.z).reshape(z.shape) for r in trained], axis=0)
            n = np.mean([np.frombuffer(r.n).reshape(n.shape) for r in trained], axis=0)
    weights = _weights(z, n)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(x.astype(np.float64) @ weights[at]).tolist() for at, x in zip(batch["grams"], batch["x"])]
            yield batch[["digest", "label"]].assign(scores=told)

    known = sampled.where(part == 0).mapInPandas(scores, "digest long, label int, scores array<double>").collect()
    known.sort(key=lambda r: (r.digest, r.label))
    told = np.array([r.scores for r in known]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(told, np.array([r.label for r in known], np.int64)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of `docs`; nothing is shuffled.

    `score` is the calibrated probability of the predicted language; the first by name of equally likely ones is
    taken. A NULL or empty text and one without a letter is `und` with score 0, and so is every text if the model knows
    no language. NULL and repeated ids are rows like others, a long text is read whole, other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((folding(), model.idf, model.weights / model.temperature))
    languages = [*model.languages, UNDETERMINED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, idf, weights = sent.value
        for batch in batches:
            for part in _chunks(batch):
                found = []
                for at, n in ngrams(part["text"].tolist(), fold):
                    if not len(at) or len(languages) == 1:
                        found.append((languages[-1], 0.0))
                        continue
                    likely = _softmax(_values(at, n, idf) @ weights[at] + weights[-1])
                    best = int(likely.argmax())
                    found.append((languages[best], float(likely[best])))
                yield pd.DataFrame(
                    {
                        "doc_id": part["id"].astype("Int64"),
                        "held_out": part["held_out"],
                        "lang_pred": [lang for lang, _ in found],
                        "score": [score for _, score in found],
                    }
                )

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), is_held_out(key).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
