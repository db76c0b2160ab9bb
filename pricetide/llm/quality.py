"""Quality classifier: EM over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import word_array, written

#: Documents that the scorer is trained on, expected, drawn by a digest of the id and text.
TRAINING_ROWS = 20_000
#: Slots of the hashed features.
SLOTS = 1 << 16
#: Frequent function words of the languages that are looked after (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that for with on as are this be by an at from or "
    "de la le les et des du un une est que qui pour dans pas au "
    "el los las y del se por con no su para "
    "der die das und den von zu mit ist im nicht ein eine auf dem"
).split()

GOOD, NONE, BAD = "g", "-", "b"


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value, which is evaluated once however often the body has it, also under conditions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _following(words: Column) -> Column:
    return F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))


def measures(text: Column, parts: Column) -> Column:
    """What the labellers look at, counted once: a struct of numbers. `parts` are the words in lower case."""
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    same = F.zip_with(parts, _following(parts), lambda a, b: a == b)
    counts = {
        "words": F.size(parts),
        "chars": F.length(text),
        "no_letters": without(r"\p{L}+"),
        "no_capitals": without(r"\p{Lu}+"),
        # Rare characters come first in a pattern: what stands before them is looked at where they are.
        "marks": F.regexp_count(text, F.lit(r"(?<=[\p{L}.,])[*#$%&!?=+~^]{2,}")),
        "stops": F.regexp_count(text, F.lit(r"(?<=\p{L})[.!?](?=\s|$)")),
        "lonely": F.size(F.filter(parts, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))),
        "echoes": F.size(F.filter(same, lambda equal: equal)),
        "distinct": F.size(F.array_distinct(parts)),
        "common": F.size(F.filter(parts, lambda w: w.isin(FUNCTION_WORDS))),
    }
    return F.struct(*(count.alias(name) for name, count in counts.items()))


def votes(text: Column) -> Column:
    """One letter per labeller: good, bad, or no opinion. NULL counts as an empty text.

    Most labellers look for one defect and have no opinion where it is missing: marks stuck to words,
    capitals, lonely separators, repeated neighbours, few different words, and little that is made of
    letters. Two know good prose as well, by its function words and by the ends of its sentences.
    """
    text = F.coalesce(text, F.lit(""))
    return _let(word_array(F.lower(text)), lambda parts: _let(measures(text, parts), _votes_of))


def _votes_of(m: Column) -> Column:
    words, some = m["words"], F.greatest(m["words"], F.lit(1))
    letters = F.greatest(m["chars"] - m["no_letters"], F.lit(1))
    wordy, common, stops = letters / some, m["common"] / some, m["stops"] / some
    never = F.lit(False)
    return F.concat(
        _vote(m["marks"] / some > 0.1, never),
        _vote((m["chars"] - m["no_capitals"]) / letters > 0.3, never),
        _vote(m["lonely"] / some > 0.1, never),
        _vote(m["echoes"] / some > 0.1, never),
        _vote((m["distinct"] / some < 0.15) & (words >= 20), never),
        _vote((wordy < 2) | (wordy > 14) | (letters / F.greatest(m["chars"], F.lit(1)) < 0.6), never),
        _vote((common < 0.01) & (words >= 50), common > 0.03),
        _vote((stops < 0.005) & (words >= 50), (stops > 0.01) & (stops < 0.6)),
    )


LABELLERS = 8


def label_model(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Probability of good for each pattern of votes, by expectation-maximisation.

    Given the class, labellers vote independently, each with rates of its own. The first guess is the
    majority; rates have a pseudo-count of 1, so that a labeller that never errs keeps a finite weight. A
    pattern is counted, not listed, so the model sees 3**LABELLERS rows at most.
    """
    names = sorted(patterns)
    if not names:
        return {}
    counts = np.array([patterns[name] for name in names], np.float64)
    letters = np.array([[(BAD + NONE + GOOD).index(v) for v in name] for name in names])
    balance = (letters - 1).sum(axis=1)
    good = 1 / (1 + np.exp(-np.clip(balance, -20, 20).astype(np.float64)))
    for _ in range(rounds):
        before = good
        mass = np.stack([counts * (1 - good), counts * good])
        prior = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        log_odds = np.full(len(names), np.log(prior[1] / prior[0]))
        for own in letters.T:
            rates = np.stack([np.bincount(own, m, 3) for m in mass]) + 1
            rates /= rates.sum(axis=1, keepdims=True)
            log_odds += np.log(rates[1] / rates[0])[own]
        good = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(good - before).max() < 1e-6:
            break
    # EM does not know which class is which: the good one is the one that agrees with good votes.
    if np.average(balance, weights=counts * good + 1e-9) < np.average(balance, weights=counts * (1 - good) + 1e-9):
        good = 1 - good
    return dict(zip(names, good.tolist()))


def features(text: Column) -> Column:
    """Terms of the scorer: words in lower case, their shapes, and a mark for every word that repeats the last."""
    text = F.coalesce(text, F.lit(""))
    shape = text
    for pattern, sign in ((r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}]+", "a"), (r"\p{Lu}+", "A"), (r"\d+", "0")):
        shape = F.regexp_replace(shape, pattern, sign)
    shapes = F.transform(word_array(shape), lambda s: F.concat(F.lit(" "), s))
    mark = lambda a, b: F.when(a == b, F.lit(" again")).otherwise(F.lit(" new"))
    marked = lambda words: F.concat(shapes, words, F.zip_with(words, _following(words), mark))
    return _let(word_array(F.lower(text)), marked)


@dataclass
class Scorer:
    hashing: HashingTF
    norm: Normalizer
    model: LogisticRegressionModel | None
    share: float  # of good documents, where there was one class only

    def vectors(self, rows: DataFrame) -> DataFrame:
        return self.norm.transform(self.hashing.transform(rows))

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds `score` to rows with `terms`."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        scored = self.model.transform(self.vectors(rows))
        return scored.withColumn("score", vector_to_array("probability")[1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> Scorer:
    """The label model over all documents, and the scorer over about `training_rows` of them.

    Where a class is rare, its likely members are drawn more often, up to half of `training_rows` for each
    class, and weigh less in turn. The penalty is lowered with the rarer class, which it would outweigh else.
    """
    texts = docs.select(F.xxhash64(id_col, text_col).alias("digest"), F.col(text_col).alias("text"))
    voted = written(texts.select("digest", votes(F.col("text")).alias("votes")), "votes")
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    counts = {row.votes: row.n for row in patterns}  # 3**LABELLERS rows at most
    good = label_model(counts)
    total = sum(counts.values())
    share = sum(counts[v] * good[v] for v in counts) / total if total else 0.5
    hashing = HashingTF(numFeatures=SLOTS, inputCol="terms", outputCol="hashed")
    norm = Normalizer(inputCol="hashed", outputCol="features", p=2.0)
    scorer = Scorer(hashing, norm, None, share)
    mass = {1: share * total, 0: sum(counts[v] * (1 - good[v]) for v in counts)}
    if min(mass.values()) < 1e-6:  # one class has no weight
        return scorer
    steps = 1 << 30
    rates = []
    for name, p in sorted(good.items()):
        of_classes = (p / mass[1] + (1 - p) / mass[0]) / 2
        rates.append((name, p, min(1.0, training_rows * max(1 / total, of_classes))))
    labels = F.broadcast(docs.sparkSession.createDataFrame(rates, "votes string, good double, rate double"))
    drawn = voted.join(labels, "votes").where(F.pmod("digest", F.lit(steps)) < F.col("rate") * steps)
    drawn = written(drawn.select("digest", "good", "rate").distinct(), "drawn")  # some `training_rows` per class at most
    sample = texts.join(F.broadcast(drawn), "digest").select("good", "rate", features(F.col("text")).alias("terms"))
    labelled = written(sample, "quality-sample")
    each = F.lit(min(1.0, training_rows / total)) / F.col("rate")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("good") * each).alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), ((1 - F.col("good")) * each).alias("weight"))))
    rows = scorer.vectors(labelled).select("features", both.alias("t")).select("features", "t.label", "t.weight")
    learner = LogisticRegression(weightCol="weight", regParam=1e-3 * min(1.0, 10 * min(share, 1 - share)), maxIter=40)
    scorer.model = learner.fit(rows.where("weight > 0"))
    return scorer


def quality(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, keep), one per row of `docs`: probability of good, and whether it is 0.5 or more.

    NULL and empty texts have no features; they get the score of a text without any. Every text is scored in
    full, where it is read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), features(F.col(text_col)).alias("terms"))
    scored = scorer.score(rows)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
