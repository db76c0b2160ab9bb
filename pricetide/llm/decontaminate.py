"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches

#: Edits allowed per character of a test item.
EDIT_RATE = 0.05
#: Characters of test items that are searched for in one pass; a larger benchmark takes several.
BLOCK_CHARS = 8_000_000

_NOT_WORD = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower case, every run of other characters than letters and digits one space, a space at both ends."""
    return f" {_NOT_WORD.sub(' ', (text or '').lower()).strip()} "


@dataclass(frozen=True)
class Item:
    item_id: int | None
    text: str
    budget: int

    @staticmethod
    def of(item_id: int | None, text: str | None, rate: float) -> Item | None:
        """None where nothing is left to search for."""
        plain = normalised(text)
        length = len(plain.strip())
        if not length:
            return None
        budget = int(length * rate)
        # Without edits the item has to be found as whole words.
        return Item(item_id, plain.strip() if budget else plain, budget)

    def pieces(self) -> Iterator[tuple[int, str]]:
        """budget + 1 pieces: whatever budget edits do, one piece stays as it is."""
        count = self.budget + 1
        for i in range(count):
            start, end = len(self.text) * i // count, len(self.text) * (i + 1) // count
            yield start, self.text[start:end]


def nearest_part(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of `pattern` to any part of `text`, and where that part ends (Myers 1999).

    Bit i of the vectors says whether the column's value grows (`up`) or falls (`down`) from row i to i + 1.
    """
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    equal_to: dict[str, int] = {}
    for i, char in enumerate(pattern):
        equal_to[char] = equal_to.get(char, 0) | 1 << i
    up, down, score = full, 0, len(pattern)
    best, end = score, 0
    for position, char in enumerate(text, 1):
        equal = equal_to.get(char, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        grows = down | (full & ~(diagonal | up))
        falls = up & diagonal
        if grows & top:
            score += 1
        elif falls & top:
            score -= 1
        grows, falls = grows << 1 & full, falls << 1 & full
        up = falls | (full & ~(vertical | grows))
        down = grows & vertical
        if score < best:
            best, end = score, position
    return best, end


class Searcher:
    """Finds all items of one block in texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for start, piece in item.pieces():
                places.setdefault(piece, []).append((number, start))
        self.pieces = ahocorasick.Automaton()
        for piece, found in places.items():
            self.pieces.add_word(piece, (len(piece), found))
        self.pieces.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Stretches (item, start, end) of the text around exact hits, overlapping ones merged."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.pieces.iter(text):
            for number, offset in places:
                item = self.items[number]
                start = last + 1 - length - offset
                span = (max(0, start - item.budget), start + len(item.text) + item.budget)
                found.setdefault(number, []).append(span)
        for number, spans in found.items():
            spans.sort()
            start, end = spans[0]
            for low, high in spans[1:]:
                if low > end:
                    yield number, start, end
                    start = low
                end = max(end, high)
            yield number, start, end

    def hits(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item number -> (least distance, end of that place in the normalised text), within the budget."""
        best: dict[int, tuple[int, int]] = {}
        if not text:
            return best
        plain = normalised(text)
        for number, start, end in self.windows(plain):
            item = self.items[number]
            distance, at = nearest_part(item.text, plain[start:end])
            if distance <= item.budget and (number not in best or distance < best[number][0]):
                best[number] = (distance, start + at)
        return best


def _searchers(benchmark: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[Searcher]:
    """One searcher per block of items; a block's size is bounded, the number of blocks is not."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).distinct().collect()
        found = [item for row in sorted(rows, key=str) if (item := Item.of(row.id, row.text, rate))]
        if found:
            yield Searcher(found)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
) -> DataFrame:
    """Rows (doc_id, item_id, distance, budget, end_pos, evidence) of documents that hold a test item.

    A document holds an item if some part of its normalised text is within `rate` edits a character of the
    item's. `distance` is the least one, `evidence` the part's surroundings. Items shorter than 1 / rate must
    occur unedited, as whole words. NULL and empty texts and items match nothing. Repeated documents and
    items with different ids give a row each. Each block of items is one scan of the documents, without a
    shuffle.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, budget int, end_pos long, evidence string"

    def search(searcher: Searcher):
        items = searcher.items

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Searcher(items)
            for batch in batches:
                rows = []
                for key, text in zip(batch["id"].astype("Int64"), batch["text"]):
                    for number, (distance, end) in own.hits(text).items():
                        item = items[number]
                        around = normalised(text)[max(0, end - len(item.text) - item.budget) : end]
                        rows.append((key, item.item_id, distance, item.budget, end, around))
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "end_pos", "evidence"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        return texts.mapInPandas(run, schema)

    parts = [search(searcher) for searcher in _searchers(benchmark, item_col, item_text_col, rate)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
) -> DataFrame:
    """`docs` without the rows that hold a test item, as `find_items` defines it; all columns stay.

    Rows are filtered where they are read, so nothing is shuffled.
    """

    def keep(searcher: Searcher):
        items = searcher.items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Searcher(items)
            for batch in batches:
                clean = [not own.hits(text) for text in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for searcher in _searchers(benchmark, item_col, item_text_col, rate):
        docs = docs.mapInArrow(keep(searcher), docs.schema)
    return docs
