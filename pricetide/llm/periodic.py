"""Periodic runs of words: minimizers of several scales propose periods, exact comparisons make runs of them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this one are found by comparing the words at that distance; longer ones by minimizers.
SHORT = 8
#: Words that are searched together, unless one text is longer.
CHUNK_WORDS = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each pair, in order."""
    x = a * _MIX
    x ^= x >> np.uint64(32)
    x += b * _OTHER
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest value of each window, by windows of half the width."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, window): the periods lo < p <= hi of texts of up to `longest` words, and their windows.

    The grams of a scale have `hi` words, so equal ones inside a run of period p lie multiples of p apart. A run
    of three periods holds two whole windows p apart, for each p of the scale: their minima are equal grams.
    """
    low = SHORT
    while LEAST_PERIODS * (low + 1) <= longest:
        high = low + low // 2
        yield low, high, 2 * (low + 1) - high + 1
        low = high


def _first_unlike(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on whose word is not that `lag` words later."""
    step, end = 64, len(words) - lag
    while at < end:
        stop = min(at + step, end)
        unlike = words[at:stop] != words[at + lag : stop + lag]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at, step = stop, 2 * step
    return end


def _last_unlike(words: np.ndarray, at: int, lag: int) -> int:
    """The last place before `at` whose word is not that `lag` words later, -1 if there is none."""
    step = 64
    while at > 0:
        stop = max(at - step, 0)
        unlike = words[stop:at] != words[stop + lag : at + lag]
        if unlike.any():
            return at - 1 - int(unlike[::-1].argmax())
        at, step = stop, 2 * step
    return -1


def _short_runs(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, min(SHORT, len(words) - 1) + 1):
        unlike = np.flatnonzero(words[lag:] != words[:-lag])
        edges = np.concatenate([[-1], unlike, [len(words) - lag]])
        lengths = np.diff(edges) - 1 + lag
        for i in np.flatnonzero(lengths >= max(LEAST_WORDS, LEAST_PERIODS * lag)).tolist():
            yield int(edges[i]) + 1, int(lengths[i]), lag


def _seeds(ranks: np.ndarray, have: int, low: int, high: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal minimizers that follow each other; ranks: digests of grams of `have` words."""
    keys = _mixed(ranks[: len(ranks) - (high - have)], ranks[high - have :])
    if len(keys) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = _sliding(keys, window, np.minimum)
    # A gram is a minimizer if it is the least of any window that holds it: the windows that begin up to window - 1 before.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, window, np.maximum) == keys)
    chosen = keys[places]
    order = np.argsort(chosen, kind="stable")
    places, chosen = places[order], chosen[order]
    lags = np.diff(places)
    seed = np.flatnonzero((chosen[1:] == chosen[:-1]) & (lags > low) & (lags <= high))
    places, lags = places[seed], lags[seed]
    order = np.lexsort((places, lags))
    return places[order], lags[order]


def _long_runs(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of the scales; `sizes` of the texts, the longest first: each scale looks at those that can hold its runs."""
    ends = np.cumsum(sizes + 1)
    ranks, have = _mixed(words.astype(np.uint64), np.full(len(words), 7, np.uint64)), 1
    for low, high, window in scales(int(sizes[0]) if len(sizes) else 0):
        texts = int(np.searchsorted(-sizes, -LEAST_PERIODS * (low + 1), side="right"))
        end = int(ends[texts - 1])
        while 2 * have <= high:
            ranks = _mixed(ranks[:-have], ranks[have:])
            have *= 2
        ranks = ranks[: max(0, end - have + 1)]
        if len(ranks) <= high - have:
            continue
        seen, covered = 0, 0
        for at, lag in zip(*(x.tolist() for x in _seeds(ranks, have, low, high, window))):
            if lag == seen and at < covered:
                continue
            stop = _first_unlike(words, at, lag)
            if stop == at:
                continue
            start = _last_unlike(words, at, lag) + 1
            seen, covered = lag, stop
            if stop - start + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                yield start, stop - start + lag, lag


def find_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text (a list of words) its runs: rows (start, length, period) by start, then period.

    Texts are searched together. A mark of its own follows each, so no run reaches into the next one: a run holds
    each of its words twice at least. A stretch is found with multiples of its period too; the least is kept.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    number = [numbers.setdefault(word, len(numbers)) for i in order for word in texts[i]]
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.full(int(firsts[-1]), -1, np.int64)
    marks = firsts[1:] - 1
    words[marks] = len(numbers) + np.arange(len(marks))
    words[words < 0] = number
    words = words.astype(np.int32) if len(words) < 1 << 30 else words
    rows = sorted({*_short_runs(words), *_long_runs(words, sizes)})
    kept = [row for i, row in enumerate(rows) if i == 0 or rows[i - 1][:2] != row[:2]]
    found = np.array(kept, np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(firsts, found[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for place, i in enumerate(order):
        out[i] = found[cuts[place] : cuts[place + 1]] - np.array([firsts[place], 0, 0])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: in a tenth of the documents, by id, all words from one on repeat."""
    n = len(words)
    digest = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if digest % 10 or not n:
        return words
    first = digest // 10 % n
    period = 1 + (n - first) // (3 + digest // 10 % 8)
    unit = words[first : first + period]
    return words[:first] + (unit * (-(-(n - first) // len(unit))))[: n - first]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit=None) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one per row of `docs`, in no order; nothing is shuffled.

    Words are what lies between the characters 9 to 13 and 32. A run is a stretch of words with least period q, at
    least max(24, 3 q) words long, that no neighbour extends; `runs` lists them as (start, length, period) by start
    and period, and `collapsed` is the text of the words that are in no run after its first period. `edit(id, words)`
    gives the words that are searched, if they are not those of the text. NULL and empty texts have no words and no
    runs; NULL and repeated ids are rows like others; a long text is searched whole; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    span = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def table(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(texts)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        flat = np.concatenate(runs or [np.empty((0, 3), np.int64)])
        spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(span))
        kept = [b" ".join(collapsed(words, r)).decode("utf-8", "surrogatepass") for words, r in zip(texts, runs)]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(words) for words in texts], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), spans),
            pa.array(kept, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                ids.append(key)
                texts.append(edit(key, words) if edit else words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield table(ids, texts)
                    ids, texts, size = [], [], 0
            yield table(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, schema)


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from `periodic_runs`: the run with the greatest exponent, and digests."""
    better = lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
    ).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
