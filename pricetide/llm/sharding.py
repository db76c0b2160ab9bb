"""Sharding by sampled splitters."""

from __future__ import annotations

from heapq import heapify, heapreplace
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import range_of, written

#: Key ranges for each shard at least, and rows of a range at most, about.
RANGES_PER_SHARD = 128
RANGE_ROWS = 1_000_000
#: Sampled keys for each range, expected.
SAMPLES_PER_RANGE = 16


def _splitters(sized: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a size-weighted sample of the keys: at most ranges - 1 bounds, ascending and distinct.

    A row is drawn with a probability in proportion to its size, by a digest of its id, so the sample has
    about ranges * SAMPLES_PER_RANGE rows whatever the input's size, and a rerun draws the same rows.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    share = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(1, total)))
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("splitters")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = sized.select("key", share.alias("share"), (F.col("size") / share).alias("weight")).where(draw < share)
    rows = drawn.groupBy("key").agg(F.sum("weight").alias("weight")).collect()
    rows.sort(key=lambda row: row.key)
    whole, so_far, bounds = sum(row.weight for row in rows), 0.0, []
    for row in rows[:-1]:
        so_far += row.weight
        if so_far >= whole * (len(bounds) + 1) / ranges:
            bounds.append(row.key)
            while so_far >= whole * (len(bounds) + 1) / ranges and len(bounds) < ranges:
                bounds.append(row.key)  # a heavy key spans several quantiles
    return sorted(set(bounds))


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shards of nearly equal bytes; equal texts stay together as long as they fit in half a shard.

    One row per row of `docs`: `doc_id`, `size` (UTF-8 bytes plus 1; a NULL text has none), `text_crc32`,
    `law` ('bytes'), `shard`, `slot` (place in the shard, from 0 without gaps), `grown_shard` (NULL: under
    this law another shard count moves rows freely). NULL and empty texts are one group. The range key is a
    digest of the text, so a group of equal texts is one key. Splitters are quantiles of a size-weighted key
    sample. Ranges are measured in full; a group that overfills its range is subdivided by a digest of the id
    (rows that also share the id stay together); then ranges go to shards, largest first, each to the least
    filled, and the pieces of a group up to half a shard go to one. The driver sees bounds and range sizes, a number that depends on shards and rows / RANGE_ROWS.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    sized = written(sized, "sized")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES_PER_SHARD * shards, ceil(rows / RANGE_ROWS))
    bounds = _splitters(sized, total, ranges)

    # Groups above two ranges' size: at most half as many as ranges.
    ideal = total / ranges
    groups = sized.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * ideal).collect()
    pieces, unit_of, units = [], {}, len(bounds) + 1
    for group in groups:
        count = ceil(group.bytes / ideal)
        pieces.append((group.key, units, count))
        if group.bytes <= total / shards / 2:  # fits into a shard: its pieces stay together
            unit_of |= {number: units for number in range(units, units + count)}
        units += count
    digest = F.pmod(F.xxhash64("doc_id", F.lit("pieces")), F.lit(1 << 30))
    own = range_of(F.col("key"), bounds).cast("int")
    ranged = sized.withColumn("range", own)
    if pieces:
        heavy = docs.sparkSession.createDataFrame(pieces, "key long, first int, pieces int")
        cut = (F.col("first") + F.floor(digest * F.col("pieces") / (1 << 30))).cast("int")
        ranged = ranged.join(F.broadcast(heavy), "key", "left").withColumn("range", F.coalesce(cut, "range"))

    found = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    together: dict[int, list] = {}
    for row in found:
        together.setdefault(unit_of.get(row.range, row.range), []).append(row)
    filled = [(0, number) for number in range(shards)]
    heapify(filled)
    shard_of, slot_of, used = [0] * units, [0] * units, [0] * shards
    for _, parts in sorted(together.items(), key=lambda unit: (-sum(row.bytes for row in unit[1]), unit[0])):
        held, number = filled[0]
        heapreplace(filled, (held + sum(row.bytes for row in parts), number))
        for row in sorted(parts, key=lambda row: row.range):
            shard_of[row.range], slot_of[row.range] = number, used[number]
            used[number] += row.rows
    place = Window.partitionBy("range").orderBy("key", "doc_id")
    index = F.col("range") + 1
    return ranged.withColumn("place", F.row_number().over(place) - 1).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(F.lit(shard_of), index).cast("int").alias("shard"),
        (F.element_at(F.lit(slot_of), index) + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
