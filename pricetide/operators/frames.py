"""Helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import scratch_path


def drop_strict(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns that must exist (`DataFrame.drop` ignores unknown names)."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any NULL; column names may hold dots, which `dropna` cannot resolve."""
    return df.where(reduce(and_, [F.col(f"`{name}`").isNotNull() for name in df.columns]))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: computed once, safe when executors are lost.

    The schema is known, so no job reads it from the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a range partition: fewer partitions than the session's for small tables, more for large ones.
FEWEST_ROWS = 50_000
MOST_ROWS = 4_000_000


def _range_partitions(table: DataFrame, fewest: int, most: int) -> int:
    rows = table.count()  # from the footers of a written table
    session = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(session, rows // fewest), ceil(rows / most))


def placed(
    df: DataFrame,
    order: list[str | Column],
    unique: bool = False,
    fewest: int = FEWEST_ROWS,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Rows in global order, as a written table with `_part` (range partition) and `_pos` (place in it).

    Ranges are even whatever the keys are, because a random last key tells equal rows apart. That key is
    written with the rows before it is used, and so is the placement: when a lost executor makes Spark
    compute a part again, it finds the same keys, and every reader sees the same places. `unique` rows
    differ in `order` and need no such key.
    """
    keys = [F.col(key) if isinstance(key, str) else key for key in order]
    if unique:
        session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(session, ceil(df.count() / most))
        ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    else:
        salted = written(df.withColumn("_salt", F.rand()), "salted")
        parts, keys = _range_partitions(salted, fewest, most), [*keys, F.col("_salt")]
        ordered = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt")
    # The id is the partition number, shifted left by 33 bits, plus the position in the partition.
    table = written(ordered.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    return table.select(
        *df.columns,
        F.shiftright("_place", 33).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def with_global_index(
    df: DataFrame, order: list[str | Column], name: str = "row_idx", unique: bool = False
) -> DataFrame:
    """Number all rows 0..n-1 in the order of `order`, without a single-partition window.

    The number is the place in the partition plus the sizes of the partitions before it. Sizes are one
    row per partition, which bounds the broadcast.
    """
    rows = placed(df, order, unique)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    number = (F.col("_offset") + F.col("_pos")).alias(name)
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, number)
