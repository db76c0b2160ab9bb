"""Alignment of two tokenizers by products of sparse token-byte and token-group incidence matrices."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import bounded_batches, written

#: Bytes of texts whose tokens are one pair of matrices, unless one text is longer.
CHUNK_BYTES = 1 << 18
#: Token ids in written tables; larger vocabularies take four bytes.
PACKED = "<u2"
#: Entries of a product that are expanded at a time.
BLOCK_ENTRIES = 1 << 18
#: Links with one of this many most frequent id pairs are scored where texts are read; others by a join.
MOST_PAIRS = 1 << 19
#: Counted id pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 20

# Fixed value: how byte-level tokenizers of the public GPT-2 family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), then those of the next range."""
    if (sizes == 1).all():
        return first
    if not len(sizes):
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)


@dataclass
class Csr:
    """A sparse 0/1 matrix in compressed rows: row i has the columns `columns[starts[i]:starts[i + 1]]`, rising."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @staticmethod
    def spans(lengths: np.ndarray) -> Csr:
        """Rows that hold the next `lengths[i]` columns each, such as the bytes of the tokens of a text."""
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return Csr(starts, np.arange(starts[-1], dtype=np.int32), int(starts[-1]))

    @staticmethod
    def labels(columns: np.ndarray, width: int) -> Csr:
        """Rows of one entry each, such as the group of a token."""
        return Csr(np.arange(len(columns) + 1, dtype=np.int32), columns, width)

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.starts))
        if np.any(self.columns[1:] < self.columns[:-1]):
            rows = rows[np.argsort(self.columns, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts.astype(np.int32), rows, self.rows)

    def row_costs(self, other: Csr) -> np.ndarray:
        """Entries that each row of the product is summed from."""
        each = np.concatenate([[0], np.cumsum(np.diff(other.starts)[self.columns], dtype=np.int64)])
        return each[self.starts[1:]] - each[self.starts[:-1]]

    def product(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nonzero cells (row, column, value) of `self` times `other`, by rows, in blocks of rows.

        Gustavson's way: row i of the product is the sum of those rows of `other` that row i of `self` names. A
        block of rows is expanded, put in order where it is not, and equal cells are added up.
        """
        ends = np.cumsum(self.row_costs(other))
        low = 0
        while low < self.rows:
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + BLOCK_ENTRIES, side="right")))
            named = self.columns[self.starts[low] : self.starts[high]]
            sizes = other.starts[named + 1] - other.starts[named]
            row = np.repeat(np.repeat(np.arange(low, high, dtype=np.int32), np.diff(self.starts[low : high + 1])), sizes)
            column = other.columns[_ranges(other.starts[named], sizes)]
            same = row[1:] == row[:-1]
            if np.any(same & (column[1:] < column[:-1])):
                order = np.lexsort((column, row))
                row, column = row[order], column[order]
            same &= column[1:] == column[:-1]
            first = np.flatnonzero(np.concatenate([[len(row) > 0], ~same]))
            yield row[first], column[first], np.diff(np.append(first, len(row)))
            low = high


def _byte_of() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_ranks(model: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, without special tokens.

    Merging by the lowest id is the file's own order of merges only where ids follow that order: this is checked.
    """
    spec = json.loads(model)
    if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level tokenizer")
    special = {token["content"] for token in spec["added_tokens"]}
    byte_of = _byte_of()
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [ranks[bytes(map(byte_of.__getitem__, "".join(m)))] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("ids do not follow the order of merges")
    return ranks


class Tokenizers:
    """Both tokenizers, with the bytes of all of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        ranks = byte_level_ranks(byte_level)
        self.a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        self.a_table = Bytes.of(a_bytes)
        self.b_table = Bytes.of([self._piece(i) for i in range(self.b.get_piece_size())])
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.a_names = {end: names(self.a_table.count, end) for end in ",|"}
        self.b_names = {end: names(self.b_table.count, end) for end in ",;"}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch(r"<0x([0-9A-F]{2})>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none for texts without tokens (NULL, empty, or not given back byte by byte)."""
        full = [text or "" for text in texts]
        told = [(" " + text).encode("utf-8", "surrogatepass") if text else b"" for text in full]
        a = [self.a.encode_to_numpy(" " + text, disallowed_special=()) if text else EMPTY for text in full]
        b = [np.array(ids, np.uint32) for ids in self.b.encode(full, num_threads=1)] if full else []
        same = self.a_table.same(a, told) & self.b_table.same(b, told)
        return [x if ok else EMPTY for x, ok in zip(a, same)], [x if ok else EMPTY for x, ok in zip(b, same)]


EMPTY = np.empty(0, np.uint32)


@dataclass
class Bytes:
    """The bytes of the tokens of a vocabulary."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Bytes:
        sizes = np.array([len(t) for t in tokens])
        return Bytes(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)

    @property
    def count(self) -> int:
        return len(self.sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.starts[ids], self.sizes[ids])]

    def same(self, texts: list[np.ndarray], told: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of the ids are those told, for each text."""
        if not texts:
            return np.empty(0, bool)
        got, want = self.joined(np.concatenate(texts)), np.frombuffer(b"".join(told), np.uint8)
        if len(got) == len(want) and (got == want).all() and all(self.sizes[ids].sum() == len(t) for ids, t in zip(texts, told)):
            return np.ones(len(texts), bool)
        return np.array([self.joined(ids).tobytes() == t for ids, t in zip(texts, told)])


@dataclass
class Aligned:
    """Tokens of some texts, one after the other, and their incidence matrices."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_first: np.ndarray  # place of each text's first token, and the end
    b_first: np.ndarray
    a_group: np.ndarray  # group of each token
    b_group: np.ndarray
    groups: int
    link_a: np.ndarray  # linked tokens
    link_b: np.ndarray
    link_bytes: np.ndarray  # bytes that they share

    @staticmethod
    def of(tokenizers: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]) -> Aligned:
        flat = lambda side: np.concatenate([EMPTY, *side]).astype(np.int64)
        first = lambda side: np.concatenate([[0], np.cumsum([len(ids) for ids in side])]).astype(np.int64)
        a_ids, b_ids = flat(a), flat(b)
        a_cells, b_cells = Csr.spans(tokenizers.a_table.sizes[a_ids]), Csr.spans(tokenizers.b_table.sizes[b_ids])
        parts = list(zip(*a_cells.product(b_cells.transposed())))
        links = [np.concatenate(p) for p in parts] if parts else [np.empty(0, np.int64)] * 3
        ends = np.zeros((2, a_cells.width + 1), bool)  # where tokens of either side end
        ends[0, a_cells.starts[1:]], ends[1, b_cells.starts[1:]] = True, True
        both = ends[0] & ends[1]
        groups = [np.cumsum(both[c.starts[1:]]) - both[c.starts[1:]] for c in (a_cells, b_cells)]
        return Aligned(a_ids, b_ids, first(a), first(b), *groups, int(both.sum()), *links)

    def keys(self, width: int) -> np.ndarray:
        """Number of the id pair of each link."""
        return self.a[self.link_a] * width + self.b[self.link_b]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the links of each text; links lie in the order of their A tokens."""
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[np.searchsorted(self.link_a, self.a_first)])

    def groups_per_text(self) -> np.ndarray:
        return np.diff(np.concatenate([self.a_group, [self.groups]])[self.a_first])

    def group_links_per_text(self) -> np.ndarray:
        """Token pairs of the same group, counted as costs of the product of the group incidences, not listed."""
        a, b = Csr.labels(self.a_group, self.groups), Csr.labels(self.b_group, self.groups)
        total = np.concatenate([[0], np.cumsum(a.row_costs(b.transposed()))])
        return np.diff(total[self.a_first])

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same pairs (A token, B token, 1), in blocks of A tokens."""
        a, b = Csr.labels(self.a_group, self.groups), Csr.labels(self.b_group, self.groups)
        return a.product(b.transposed())

    def told(self, tokenizers: Tokenizers) -> list[str]:
        """Groups of each text, as `a1,a2|b1;a3|b2,b3`."""
        last_a = np.concatenate([self.a_group[1:] != self.a_group[:-1], [True]]) if len(self.a) else np.empty(0, bool)
        last_b = np.concatenate([self.b_group[1:] != self.b_group[:-1], [True]]) if len(self.b) else np.empty(0, bool)
        a_sizes, b_sizes = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        a_before, b_before = np.cumsum(a_sizes), np.cumsum(b_sizes) - b_sizes
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[np.arange(len(self.a)) + b_before[self.a_group]] = np.where(
            last_a, tokenizers.a_names["|"][self.a], tokenizers.a_names[","][self.a]
        )
        out[np.arange(len(self.b)) + a_before[self.b_group]] = np.where(
            last_b, tokenizers.b_names[";"][self.b], tokenizers.b_names[","][self.b]
        )
        cuts = (self.a_first + self.b_first).tolist()
        return ["".join(out[low:high].tolist())[:-1] for low, high in zip(cuts, cuts[1:])]


def _sent(spark: SparkSession, byte_level: str, pieces: str):
    """The two vocabulary files, read on the driver: executors need not have them."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        files = {"byte_level": a.read(), "pieces": b.read()}
    byte_level_ranks(files["byte_level"])
    return spark.sparkContext.broadcast(files)


def _received(files: dict) -> Tokenizers:
    """Made once in each worker process: a broadcast value stays there."""
    if "made" not in files:
        files["made"] = Tokenizers(files["byte_level"], files["pieces"])
    return files["made"]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[list]]:
    """The columns of rows whose second values have `most` parts together, or one row more."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        ends = np.cumsum([len(value or "") for value in columns[1]]) // most
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), batch.num_rows]
        yield from ([c[low:high] for c in columns] for low, high in zip(cuts, cuts[1:]) if low < high)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, added up."""
    keys, counts = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _tokenized(rows: DataFrame, files) -> tuple[DataFrame, DataFrame]:
    """The tokens (id, a, b) of all rows, packed as numbers of PACKED, and counts (a, b, n) of linked id pairs.

    Texts are read and encoded once: one table is written that holds rows of both kinds. Tasks add counts up before
    they hand them on, and hold HELD_PAIRS pairs and those of one chunk at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _received(files.value)
        width = own.b_table.count
        none = lambda n, kind: pa.nulls(n, kind)

        def counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            n, ids = len(keys), [pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32))]
            empty = [none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, *ids, pa.array(counts, pa.int64())], names)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, texts in _chunks(batches, CHUNK_BYTES):
            a, b = own.encode(texts)
            held.append(np.unique(Aligned.of(own, a, b).keys(width), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                held = [_summed(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield counted(*held.pop())
            packed = [pa.array([x.astype(PACKED).tobytes() for x in side], pa.binary()) for side in (a, b)]
            counts = [none(len(ids), kind) for kind in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *packed, *counts], names)
        if held:
            yield counted(*_summed(held))

    names = ["id", "a", "b", "pair_a", "pair_b", "n"]
    table = written(rows.mapInArrow(run, "id long, a binary, b binary, pair_a int, pair_b int, n long"), "tokens")
    counts = table.where("pair_a IS NOT NULL").select(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), "n")
    return table.where("a IS NOT NULL").select("id", "a", "b"), counts


def _pairs(counts: DataFrame) -> DataFrame:
    """Rows (a, b, n, best): the links of an id pair in all documents, and whether no pair of its B id has more."""
    sums = written(counts.groupBy("a", "b").agg(F.sum("n").alias("n")), "linked-ids")
    most = sums.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of the B vocabulary at most
    return written(sums.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "counted-ids")


def _frequent_from(pairs: DataFrame, most_pairs: int) -> int:
    """The least count so that no more than `most_pairs` pairs have it; counts over 4096 go by powers of two."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(2.0, F.floor(F.log2("n"))).cast("long"))
    sizes = {r.level: r.pairs for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, 1 << 62
    for key in sorted(sizes, reverse=True):
        total += sizes[key]
        if total > most_pairs:
            return least
        least = key
    return 1


def align(
    docs: DataFrame,
    byte_level: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    told: Callable[[Column], Column] = lambda groups: groups.alias("groups"),
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_group_links, groups), one per row of `docs`.

    `byte_level` and `pieces` are the vocabulary files of tokenizers A and B. Both encode a space and the text. An A
    and a B token are linked where they share bytes: the cells of the product of A's token-byte matrix and B's
    transposed one. Groups lie between offsets where tokens of both end; `n_group_links` counts pairs within them. An
    id pair's count is the number of its links in all documents; `n_best` counts links whose pair has its B id's
    highest, ties included, `count_sum` adds the counts of all links. `told` makes a column of the groups, which are
    texts such as `a1,a2|b1;a3|b2,b3`, before rows are written.

    Texts are read and encoded once, and neither they nor their tokens are shuffled: the tokens are written, and read
    again when the counts are known. The counts of the `most_pairs` most frequent pairs travel to the tasks;
    links with rarer ones are joined with theirs, so every link is scored by its exact count.

    NULL and empty texts and texts that a tokenizer does not give back byte by byte have no tokens: zeros and ''.
    NULL and repeated ids are rows like others; special tokens' strings are plain text; a text is one pair of
    matrices however long; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    files = _sent(spark, byte_level, pieces)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens, counts = _tokenized(rows, files)
    pairs = _pairs(counts)
    least = _frequent_from(pairs, most_pairs)
    known = pairs.where(F.col("n") >= least).toArrow()
    counted = spark.sparkContext.broadcast({name: known[name].to_numpy() for name in known.column_names})
    del known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = _received(files.value), counted.value
        width = own.b_table.count
        if "place" not in table:
            table["place"] = pd.Index(table["a"].astype(np.int64) * width + table["b"])
        for ids, *sides in _chunks(batches, CHUNK_BYTES):
            found = Aligned.of(own, *([np.frombuffer(x, PACKED) for x in side] for side in sides))
            keys = found.keys(width)
            place = table["place"].get_indexer(keys) if len(table["a"]) else np.full(len(keys), -1)
            rare = place < 0
            n = np.where(rare, 0, np.append(table["n"], 0)[place])
            best = np.where(rare, False, np.append(table["best"], False)[place])
            offsets = np.concatenate([[0], np.cumsum(found.per_text(rare))]).astype(np.int32)
            columns = [
                np.diff(found.a_first),
                np.diff(found.b_first),
                found.groups_per_text(),
                found.per_text(np.ones(len(keys), np.int64)),
                found.per_text(best),
                found.per_text(n),
                found.group_links_per_text(),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    *(pa.array(c, pa.int64()) for c in columns),
                    pa.array(found.told(own), pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[rare], pa.int64())),
                ],
                names,
            )

    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links"]
    names = ["doc_id", *sums, "groups", "rare"]
    schema = ", ".join(["doc_id long", *(f"{name} long" for name in sums), "groups string", "rare array<long>"])
    shown = tokens.mapInArrow(run, schema).select("doc_id", *sums, told(F.col("groups")), "rare")
    if least == 1:
        return shown.drop("rare")
    shown = written(shown.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    rest = pairs.where(F.col("n") < least).select((F.col("a").cast("long") * width + F.col("b")).alias("key"), "n", "best")
    links = shown.select("_row", F.explode("rare").alias("key"))
    links = links.groupBy("_row", "key").agg(F.count("*").alias("links")).join(rest, "key")
    more = links.groupBy("_row").agg(
        F.sum(F.col("links") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum")
    )
    plus = {"n_best": "_best", "count_sum": "_sum"}
    kept = [c for c in shown.columns if c not in ("rare", "_row")]
    whole = [(F.col(c) + F.coalesce(F.col(plus[c]), F.lit(0))).alias(c) if c in plus else F.col(c) for c in kept]
    return shown.drop("rare").join(more, "_row", "left").select(*whole)
