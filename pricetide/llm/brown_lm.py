"""Language-model scoring with Brown classes: exchange clustering, class n-grams, word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches, tokens, written

#: What is taken off the counts of words, at most: where no word occurs exactly twice, the estimate would be all of 1.
MOST_DISCOUNT = 0.95
#: Words that tasks hold in memory with their counts and classes, whose neighbours they sum in an array, and that the
#: exchange moves: the most frequent ones, up to these numbers. Every other word is a row of a table.
COUNTED, CLASSED, EXCHANGED = 1 << 17, 1 << 15, 1 << 11
#: Word classes; every training word is in one. One more holds the end mark, and one the words not seen in training.
CLASSES = 48
ROUNDS = 8
#: Distinct keys that a task collects before it hands them on.
TASK_KEYS = 200_000
#: Characters that a task splits into words at once.
TASK_CHARS = 4_000_000

#: The end mark; no word holds a line feed.
END = b"\n"


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _trained_on(keys: pa.Array) -> np.ndarray:
    return np.fromiter((key is None or not is_held_out(key) for key in keys.to_pylist()), bool, len(keys))


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n) of all training tokens; the end mark is one of them."""

    def table(found: Counter) -> pa.RecordBatch:
        words = [word.decode("utf-8", "replace") for word in found]
        return pa.RecordBatch.from_pydict({"key": pa.array(words, pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for trained, text in zip(_trained_on(batch.column("id")), batch.column("text")):
                if trained:
                    found.update(tokens(text.as_py()))
                    found[END] += 1
            if len(found) > TASK_KEYS:
                yield table(found)
                found.clear()
        yield table(found)

    rows = texts.mapInArrow(run, "key string, n long")
    return rows.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"))


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def numbered(texts: DataFrame, sent) -> DataFrame:
    """Written rows (row, id, trained, words, rare) of the texts: numbers of their words by the broadcast table, -1 where
    a word is not in it, and these words in order. Texts are split into words once, here."""

    def part(keys: list, texts: list) -> pa.RecordBatch:
        split = [tokens(text) for text in texts]
        words = [word for of_text in split for word in of_text]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(sent.value.get, words, repeat(-1)), np.int32, len(words))
        where = np.flatnonzero(at < 0)
        rare = [words[i].decode("utf-8", "replace") for i in where]
        of_text = np.repeat(np.arange(len(split)), lengths)
        columns = {
            "id": pa.array(keys, pa.int64()),
            "trained": pa.array([key is None or not is_held_out(key) for key in keys], pa.bool_()),
            "words": _lists(lengths, pa.array(at, pa.int32())),
            "rare": _lists(np.bincount(of_text[where], minlength=len(split)), pa.array(rare, pa.string())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, chars = [], [], 0
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                keys.append(key)
                held.append(text.as_py())
                chars += len(held[-1] or "")
                if chars > TASK_CHARS:
                    yield part(keys, held)
                    keys, held, chars = [], [], 0
            if keys:
                yield part(keys, held)

    rows = texts.mapInArrow(run, "id long, trained boolean, words array<int>, rare array<string>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _laid_out(lengths: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all lists in one array, with `end` before and after each list; which are values, and which follow
    another of their list. What is two places before a list's first value is an end as well."""
    first = np.cumsum(lengths + 2) - (lengths + 2)
    flat = np.full(int((lengths + 2).sum()), end, np.int64)
    inside, follows = np.ones(len(flat), bool), np.ones(len(flat), bool)
    inside[first] = inside[first + lengths + 1] = follows[first] = False
    flat[inside] = values
    return flat, inside, follows


def _of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("words")
    return _lengths(lists), lists.flatten().to_numpy()


def _summed(rows: DataFrame, make, size: int) -> pa.Table:
    """Sums (key, n) over all rows of the counts of the keys below `size` that `make` finds in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            keys, times = np.unique(make(batch), return_counts=True)
            found[keys] += times
        keys = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(found[keys], pa.int64())})

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, `most` at most; words of one frequency are taken together or not at all."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, held = None, 0
    for row in sizes:
        held += row.words
        if held > most:
            break
        least = row.n
    if least is None:
        return []
    rows = counts.where(F.col("n") >= least).collect()
    return sorted(((row.word.encode(), row.n) for row in rows), key=lambda w: (-w[1], w[0]))


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS, fixed: int = 1) -> np.ndarray:
    """Classes of words from their matrix of neighbour counts; the last `fixed` words are a class of their own each.

    These are the end mark and, if there is one more, all words without a row of their own taken as one. The most
    frequent words begin a class each, and the others join one, in turn. Then every word moves to the class that
    gains most likelihood of the class bigrams, until none moves or the rounds are over. The matrix has
    EXCHANGED + 1 words at most.
    """
    n = len(pairs)
    of = np.where(np.arange(n) < classes, np.arange(n), -1)
    of[n - fixed :] = classes + np.arange(fixed)
    for _ in range(rounds):
        moved = 0
        z = (of[:, None] == np.arange(classes + fixed)).astype(np.float64)
        right, left = pairs @ z, pairs.T @ z
        grid = z.T @ right
        for w in range(n - fixed):
            old, own = of[w], float(pairs[w, w])
            r, l = right[w].copy(), left[w].copy()
            if old >= 0:
                grid[old] -= r
                grid[:, old] -= l
                grid[old, old] += own
                r[old] -= own
                l[old] -= own
            # Sums that hold wherever the word goes: its neighbours' rows and columns now count it.
            rows, columns = grid.sum(axis=1) + l, grid.sum(axis=0) + r
            base = _h(grid)
            diagonal = np.diagonal(grid)
            gain = (_h(grid + r) - base).sum(axis=1) + (_h(grid + l[:, None]) - base).sum(axis=0)
            gain -= _h(diagonal + r) + _h(diagonal + l) - 2 * _h(diagonal)
            gain += _h(diagonal + r + l + own) - _h(diagonal)
            gain -= _h(rows + r.sum() + own) - _h(rows) + _h(columns + l.sum() + own) - _h(columns)
            gain[classes:] = -np.inf
            new = int(gain.argmax())
            if old >= 0 and gain[new] <= gain[old] + 1e-9:
                new = old
            r[new] += own
            l[new] += own
            grid[new] += r
            grid[:, new] += l
            grid[new, new] -= own
            if new != old:
                moved += 1
                of[w] = new
                before, after = pairs[:, w], pairs[w]
                if old >= 0:
                    right[:, old] -= before
                    left[:, old] -= after
                right[:, new] += before
                left[:, new] += after
        if not moved:
            break
    return of


@dataclass
class Model:
    """Classes and probabilities of all training words. Class CLASSES is the end mark's, CLASSES + 1 that of unseen words.

    The `held` most frequent words travel to tasks; the others are the rows (word, n, kind) of `rare`.
    """

    held: dict[bytes, int]
    own: np.ndarray  # counts of the words in `held`, most frequent first
    kinds: np.ndarray  # their classes
    rare: DataFrame
    mass: np.ndarray  # training tokens of each class
    ends: int  # training texts
    n: int  # training tokens
    v: int  # distinct ones
    steps: np.ndarray  # log10 P(class | two classes before)
    discount: float
    unseen: float = 0.0  # log10 P(a word not seen in training | its class): all of them count as one

    @property
    def per_token(self) -> float:
        return float(self.n + self.v + 1)

    @cached_property
    def _rare(self) -> pd.DataFrame:
        """All rows of `rare` in the driver: to look at small models."""
        return self.rare.orderBy(F.desc("n"), "word").toPandas()

    @cached_property
    def ids(self) -> dict[bytes, int]:
        """Numbers of all training words, for `of`, `counts` and `emit`; for small models, as these are."""
        return self.held | {word.encode(): len(self.held) + i for i, word in enumerate(self._rare["word"])}

    @cached_property
    def of(self) -> np.ndarray:
        return np.append(self.kinds, self._rare["kind"]).astype(np.int64)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.append(self.own, self._rare["n"]).astype(np.float64)

    @cached_property
    def emit(self) -> np.ndarray:
        """log10 P(word | its class)."""
        return np.log10(self.counts / self.mass[self.of])


def _log_steps(grid: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b) of class trigram counts: absolute discounting over bigrams, unigrams, and a uniform share."""
    size = len(grid)

    def discounted(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=-1, keepdims=True)
        taken = np.minimum(counts, 0.7)  # counts may be parts of one
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (counts - taken) / total + taken.sum(axis=-1, keepdims=True) / total * below
        return np.where(total > 0, found, below)

    single = discounted(grid.sum(axis=(0, 1)), np.full(size, 1 / size))
    return np.log10(discounted(grid, discounted(grid.sum(axis=0), single)[None]))


def _fitting(rows: DataFrame, near: int, known: np.ndarray, grid: np.ndarray) -> DataFrame:
    """Written rows (word, n, kind): the class that fits the neighbours best of each word that the exchange has not moved.

    The word is a line feed and its number for words of the table. Neighbours count by their classes: `known` for the
    words of the table, one class for all others. Counts are gathered by word, so any number of words is spread over tasks.
    """
    size = CLASSES + 2
    classed = len(known)
    base = 2 * size + size * size  # codes: class before, class after, both
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(known)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of = sent.value
        summed = np.zeros(max(classed - near, 0) * 2 * size, np.int64)
        names = {"word": pa.string(), "code": pa.int64()}
        for batch in batches:
            lengths, at = _of_batch(batch)
            kinds = np.full(len(at), CLASSES + 1)
            within = (at >= 0) & (at < classed)
            kinds[within] = kinds_of[at[within]]
            flat, inside, _ = _laid_out(lengths, kinds, CLASSES)
            place = np.flatnonzero(inside)
            before, after = flat[place - 1], flat[place + 1]
            dense = within & (at >= near)
            of_word = (at[dense] - near) * 2 * size
            keys, times = np.unique(np.concatenate([of_word + before[dense], of_word + size + after[dense]]), return_counts=True)
            summed[keys] += times
            code = base + 2 * size + before * size + after  # once
            table, none = np.flatnonzero(at >= classed), at < 0
            words = pa.array([f"\n{i}" for i in at[table].tolist()], pa.string())
            words = pa.concat_arrays([words, batch.column("rare").flatten()])
            codes = pa.array(np.concatenate([code[table], code[none]]), pa.int64())
            yield pa.RecordBatch.from_arrays([words, codes], schema=pa.schema(names))
        keys = np.flatnonzero(summed)
        words = pa.array([f"\n{near + i}" for i in (keys // (2 * size)).tolist()], pa.string())
        codes = pa.array(summed[keys] * base + keys % (2 * size), pa.int64())
        yield pa.RecordBatch.from_arrays([words, codes], schema=pa.schema(names))

    inward = np.log(grid[:, :-2] / grid[:, :-2].sum(axis=0))  # P(class before | class)
    onward = np.log(grid[:-2] / grid[:-2].sum(axis=1, keepdims=True)).T  # P(class after | class)
    weights, prior = np.concatenate([inward, onward]), np.log(grid[:, :-2].sum(axis=0))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("codes")
            of_word = np.repeat(np.arange(len(lists)), _lengths(lists))
            times, code = np.divmod(lists.flatten().to_numpy(), base)
            both = code >= 2 * size
            before, after = np.divmod(code[both] - 2 * size, size)
            keys = [of_word[~both] * 2 * size + code[~both], of_word[both] * 2 * size + before]
            keys = np.concatenate([*keys, of_word[both] * 2 * size + size + after])
            seen = np.bincount(keys, np.concatenate([times[~both], times[both], times[both]]), len(lists) * 2 * size)
            seen = seen.reshape(-1, 2 * size)
            kinds = np.round(seen @ weights + prior, 9).argmax(axis=1)
            n = seen[:, :size].sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n), pa.array(kinds, pa.int32())], ["word", "n", "kind"])

    found = rows.select("words", "rare").mapInArrow(neighbours, "word string, code long")
    found = found.groupBy("word").agg(F.collect_list("code").alias("codes"))
    return written(found.mapInArrow(best, "word string, n long, kind int"), "classes")


def _classified(rows: DataFrame, own: np.ndarray, kinds: np.ndarray, rare: DataFrame, mass: np.ndarray, per_token: float) -> DataFrame:
    """Written rows (id, trained, words, n_known, base, emit): classes of the words of numbered rows, those of words seen
    once as CLASSES + 2 plus their class, and the sums of the words' log10 probabilities under counts and given their class."""
    tokens_ = rows.select("row", F.posexplode("rare").alias("pos", "word"))
    met = tokens_.join(rare, "word", "left").groupBy("row")
    found = F.struct("pos", F.coalesce("kind", F.lit(-1)).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))
    met = met.agg(F.array_sort(F.collect_list(found)).alias("met"))
    both = rows.select("row", "id", "trained", "words").join(met, "row", "left")
    none = F.array().cast("array<int>")
    both = both.select(
        "id", "trained", "words", F.coalesce("met.kind", none).alias("kinds"),
        F.coalesce("met.n", none.cast("array<bigint>")).alias("ns"),
    )
    sent = rows.sparkSession.sparkContext.broadcast((own, kinds, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds_of, mass = sent.value
        for batch in batches:
            lengths, at = _of_batch(batch)
            kinds, n = np.full(len(at), -1), np.zeros(len(at))
            found = at >= 0
            kinds[found], n[found] = kinds_of[at[found]], own[at[found]]
            kinds[~found], n[~found] = batch.column("kinds").flatten().to_numpy(), batch.column("ns").flatten().to_numpy()
            seen = kinds >= 0
            emit = np.zeros(len(at))
            emit[seen] = np.log10(n[seen] / mass[kinds[seen]])
            kinds = np.where(seen, kinds, CLASSES + 1) + np.where(n == 1, CLASSES + 2, 0)
            of_text = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda values: np.bincount(of_text, values, len(lengths))
            columns = {
                "id": batch.column("id"),
                "trained": batch.column("trained"),
                "words": _lists(lengths, pa.array(kinds, pa.int32())),
                "n_known": pa.array(add(seen).astype(np.int64)),
                "base": pa.array(add(np.log10((n + 1) / per_token))),
                "emit": pa.array(add(emit)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = "id long, trained boolean, words array<int>, n_known long, base double, emit double"
    return written(both.mapInArrow(run, schema), "classified")


def _fit(docs: DataFrame, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    bounded_batches(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    counts = written(word_counts(texts), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == END.decode()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = {row.n: row.k for row in counts.where("n < 3").groupBy("n").agg(F.count("*").alias("k")).collect()}
    once, twice = few.get(1, 0), few.get(2, 0)
    discount = min(once / (once + 2 * twice), MOST_DISCOUNT) if once else 0.5
    words = [w for w in _frequent(counts, COUNTED) if w[0] != END]
    held = {word: i for i, (word, _) in enumerate(words)}
    own = np.array([c for _, c in words], np.float64)
    near, classed = min(EXCHANGED - 1, len(words)), min(CLASSED, len(words))
    rows = numbered(texts, texts.sparkSession.sparkContext.broadcast(held))
    trained = rows.where("trained")

    # Neighbours of the most frequent words; the end mark stands before the first and after the last word, and
    # all other words are one.
    def pairs(batch: pa.RecordBatch) -> np.ndarray:
        lengths, at = _of_batch(batch)
        flat, _, follows = _laid_out(lengths, np.where((at < 0) | (at >= near), near + 1, at), near)
        place = np.flatnonzero(follows)
        return flat[place - 1] * (near + 2) + flat[place]

    table = _summed(trained.select("words"), pairs, (near + 2) ** 2)
    matrix = np.zeros((near + 2) ** 2, np.float64)
    matrix[table["key"].to_numpy()] = table["n"].to_numpy()
    del table
    matrix = matrix.reshape(near + 2, near + 2)
    found = exchange(matrix, CLASSES, fixed=2)

    # Every other word joins the class that fits its neighbours best.
    z = np.eye(CLASSES + 2)[found]
    grid = z.T @ (matrix @ z) + 0.1
    del matrix
    known = np.append(found[:-2], np.full(classed - near, CLASSES + 1))
    fitting = _fitting(trained, near, known, grid)
    number = F.when(F.col("word").startswith("\n"), F.substring("word", 2, 20).cast("int"))
    kinds = np.append(found[:-2], np.full(len(words) - near, CLASSES + 1))
    for row in fitting.select(number.alias("number"), "kind").where("number IS NOT NULL").collect():
        kinds[row.number] = row.kind
    rare = fitting.where(number.isNull())
    mass = np.bincount(kinds, own, CLASSES + 2) if len(kinds) else np.zeros(CLASSES + 2)
    for row in rare.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        mass[row.kind] += row.n
    classified = _classified(rows, own, kinds, rare, mass, float(n + v + 1))

    # What is not seen in training stands where words seen once stand: with the share of the discount, trigrams
    # have the class of unseen words in the place of theirs.
    size = CLASSES + 2

    def trigrams(batch: pa.RecordBatch) -> np.ndarray:
        lengths, of_words = _of_batch(batch)
        keys = []
        for i, once_as in enumerate((of_words % size, np.where(of_words >= size, CLASSES + 1, of_words))):
            flat, _, follows = _laid_out(lengths, once_as, CLASSES)
            place = np.flatnonzero(follows)
            two = np.append(CLASSES, flat)[place - 1]  # before the first list as well
            keys.append(((i * size + two) * size + flat[place - 1]) * size + flat[place])
        return np.concatenate(keys)

    table = _summed(classified.where("trained").select("words"), trigrams, 2 * size**3)
    cube = np.zeros(2 * size**3)
    cube[table["key"].to_numpy()] = table["n"].to_numpy()
    as_classed, as_unseen = cube.reshape(2, size, size, size)
    steps = _log_steps((1 - discount) * as_classed + discount * as_unseen)
    return Model(held, own, kinds, rare, mass, int(ends), int(n), int(v), steps, discount), classified


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the written rows (word, n, kind) of the training words that it does not hold in memory.

    Words are counted over the whole training texts, and every one of them is in a class: exchange moves the most
    frequent ones, a neighbour outside their table counting as one of its last row and column, and each other word
    joins the class that fits its neighbours best. Class trigrams are counted over the classes of all words. The driver
    holds tables whose size the parameters bound: COUNTED words, (EXCHANGED + 1)**2 neighbour counts, and twice
    (CLASSES + 2)**3 trigrams.
    """
    model, _ = _fit(docs, id_col, text_col)
    return model, model.rare


def fit_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of the texts by the model that is fitted to them; texts are split into words for both at once."""
    model, classified = _fit(docs, id_col, text_col)
    return _scored(classified, model)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one per row of `docs`.

    `score` is the model's log10 probability of the text: a class given the two classes before, times the
    word given its class; classes are smoothed by absolute discounting. The words never seen count as one, in a class
    of their own, as in `base_score`. An empty and a NULL text are the end mark alone. A NULL id is not held out.
    Only words that are not among the COUNTED ones meet their counts and classes, the rows of `counts`, in a join.
    """
    bounded_batches(docs.sparkSession)
    rows = numbered(_texts(docs, id_col, text_col), docs.sparkSession.sparkContext.broadcast(model.held))
    classified = _classified(rows, model.own, model.kinds, counts, model.mass, model.per_token)
    return _scored(classified, model)


def _scored(classified: DataFrame, model: Model) -> DataFrame:
    size = CLASSES + 2
    sent = classified.sparkSession.sparkContext.broadcast(model.steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, of_words = _of_batch(batch)
            flat, _, follows = _laid_out(lengths, of_words % size, CLASSES)
            place = np.flatnonzero(follows)
            steps = sent.value[np.append(CLASSES, flat)[place - 1], flat[place - 1], flat[place]]
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths + 1), steps, len(lengths))
            rest = [batch.column(name) for name in ("id", "trained", "n_known", "base", "emit")]
            names = ["id", "trained", "n_known", "base", "emit", "n_tokens", "steps"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lengths + 1, pa.int64()), pa.array(sums, pa.float64())], names)

    schema = "id long, trained boolean, n_known long, base double, emit double, n_tokens long, steps double"
    total = F.col("emit") + F.col("steps")
    return classified.mapInArrow(run, schema).select(
        F.col("id").alias("doc_id"),
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.lit(int(model.ends > 0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10((F.lit(model.ends) + 1) / F.lit(model.per_token))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
