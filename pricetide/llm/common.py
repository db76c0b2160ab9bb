"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from math import isqrt

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.frames import written

__all__ = ["WORD", "Hashes", "bounded_batches", "components", "lower_ascii", "range_of", "read", "tokens", "word_array", "written"]

#: A word of the contracts: anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch: texts are long, and a Python worker holds a few batches at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in batches of at most BATCH_ROWS rows, to bound the workers' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def tokens(text: str | None) -> list[bytes]:
    """The same words, A-Z in lower case, as UTF-8. `bytes.lower` and `bytes.split` know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below the key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    coarse = bounds[step - 1 :: step]
    first = F.size(F.filter(F.lit(coarse), lambda b: b < key)) * step if coarse else F.lit(0)
    fine = F.slice(F.lit(bounds), first + 1, F.lit(step))
    return first + F.size(F.filter(fine, lambda b: b < key))


def _only_stars(edges: DataFrame) -> bool:
    """Whether no node is the greater one of two of the edges (a < b), or the greater one here and the smaller one there."""
    ends = edges.selectExpr("a AS id", "0 AS above").unionByName(edges.selectExpr("b AS id", "1 AS above"))
    of_node = ends.groupBy("id").agg(F.sum("above").alias("above"), F.count("*").alias("n"))
    return of_node.where("above > 1 OR above = 1 AND n > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the edges (a, b): one row (id, component) for each node of an edge.

    `component` is the smallest id of the component. Large-star and small-star rounds alternate until the
    edges are stars, each around its smallest id; edges that are so from the start take no round. A node's smallest
    neighbour is an aggregate that is joined back, so a node with many neighbours is no group in one task.
    """
    flat = edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    current = written(flat, f"{name}-edges")
    while not _only_stars(current):
        both = current.unionByName(current.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("m AS a", "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.selectExpr("m AS a", "b").unionByName(joined.selectExpr("m AS a", "a AS b"))
        current = written(small.where("a <> b").distinct(), f"{name}-edges")
    roots = current.selectExpr("a AS id", "a AS component").distinct()
    return current.selectExpr("b AS id", "a AS component").unionByName(roots)
