"""Training rows, day index, time splits and cross-validation folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.frames import drop_strict, with_global_index

# Days kept, training days after the first one, columns a training row needs or loses.
KEPT_DAYS = 30
TRAIN_DAYS = 20
NEEDED = ["diesel", "diesel_shift", "price_will_change"]
NOT_TRAINED_ON = ["e5", "e10"]


def train_rows(features: DataFrame) -> DataFrame:
    """Rows with a known price, next price and label."""
    return drop_strict(features.dropna(subset=NEEDED), *NOT_TRAINED_ON)


def day_calendar(
    rows: DataFrame, day: str = "day_key", keep: int = KEPT_DAYS, train_days: int = TRAIN_DAYS
) -> DataFrame:
    """The last `keep` observed days with their dense index and their split.

    Only the distinct days pass the unpartitioned windows. Training days are the first kept day and
    the `train_days` days after it.
    """
    everything = Window.partitionBy(F.lit(0))
    days = rows.where(F.col(day).isNotNull()).select(day).distinct()
    indexed = days.withColumn("day_idx", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(day)))
    kept = indexed.withColumn("_max", F.max("day_idx").over(everything)).where(F.col("day_idx") > F.col("_max") - keep)
    cutoff = F.min("day_idx").over(everything) + train_days
    return kept.select(day, "day_idx", F.when(F.col("day_idx") <= cutoff, "train").otherwise("test").alias("split"))


def with_day_split(
    rows: DataFrame, day: str = "day_key", keep: int = KEPT_DAYS, train_days: int = TRAIN_DAYS
) -> DataFrame:
    """Keep the rows of the last `keep` observed days; add `day_idx` and `split`.

    The broadcast has one row per kept day. On a table stored by day the inner join prunes partitions.
    """
    return rows.join(F.broadcast(day_calendar(rows, day, keep, train_days)), day)


def resplit(rows: DataFrame, train_days: int = TRAIN_DAYS) -> DataFrame:
    """Another train / valid border on rows that already have `day_idx` (one row per kept day is broadcast)."""
    days = rows.select("day_idx").distinct()
    cutoff = F.min("day_idx").over(Window.partitionBy(F.lit(0))) + train_days
    border = days.withColumn("split", F.when(F.col("day_idx") <= cutoff, "train").otherwise("valid"))
    return rows.drop("split").join(F.broadcast(border), "day_idx")


def hash_folds(rows: DataFrame, k: int, key: str = "id", name: str = "fold") -> DataFrame:
    """Fold by hash of the record id: no shuffle, about equal sizes, stable when rows are recomputed."""
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def _dealt_up_to(rows: Column, fold: int, k: int) -> Column:
    """How many of the first `rows` cards, dealt to k folds in turn, went to folds 0..fold."""
    return F.floor(rows / k) * (fold + 1) + F.least(rows % k, F.lit(fold + 1))


def stratified_folds(rows: DataFrame, k: int, order: list[str], label: str, name: str = "fold") -> DataFrame:
    """Contiguous stratified folds in the order of `order`, which must identify a row.

    Classes are lined up by first appearance and dealt to the folds in turn, which fixes how many rows
    of a class a fold gets; a class then fills its folds block by block in row order. Two labels would
    make two window partitions, so the row number comes from a range-partitioned index instead.
    """
    indexed = with_global_index(rows, [label, *order], "_pos", unique=True)
    starts = indexed.groupBy(label).agg(F.count("*").alias("_n"), F.min("_pos").alias("_start"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.col("_before"), F.col("_before") + F.col("_n")
    classes = (  # the first row of every class
        indexed.join(F.broadcast(starts), label)
        .where(F.col("_pos") == F.col("_start"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(
            label,
            "_start",
            F.array(*[_dealt_up_to(after, i, k) - _dealt_up_to(before, i, k) for i in range(k)]).alias("_ends"),
        )
    )
    position = F.col("_pos") - F.col("_start")
    fold = F.size(F.filter("_ends", lambda end: end <= position))
    return indexed.join(F.broadcast(classes), label).withColumn(name, fold).drop("_pos", "_start", "_ends")
