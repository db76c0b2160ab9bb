"""Database text dumps: landing, cutting out COPY sections, parsing their rows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.text import parse_utc, strip
from pricetide.operators.frames import written
from pricetide.schemas import PRICE_SCHEMA, STATION_SCHEMA
from pricetide.sources.rows import typed_rows

# The line that ends a COPY section, and the fewest fields a price row may have.
END_OF_SECTION = "\\."
MIN_PRICE_FIELDS = 6


def land_dump(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write the lines of a dump with their order as a table, and read it back.

    A text scan numbers its lines only relative to the splits it was planned with, so the number is
    written down once and later steps cannot disagree about it. A gzip dump is one task in any engine;
    this step is where it becomes splittable.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )
    lines.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _starts(table: str) -> Column:
    """Marker line of exactly this table: one table's name may begin another's."""
    marker = f"COPY public.{table}"
    line = F.col("line")
    return line.startswith(f"{marker} ") | line.startswith(f"{marker}(")


def copy_sections(lines: DataFrame, tables: list[str]) -> dict[str, DataFrame]:
    """For every table the lines between its COPY marker and the end marker after it.

    One scan finds all markers and writes them down: two and a few per table of the dump, a data line cannot
    be an end marker, as COPY text escapes the backslash. Two aggregates over them give one start and one end
    per table, which is all that comes to the driver. Where positions are landed ones, the cuts are bounds on
    file, block and row as well, which reach the scan.
    """
    is_end = F.trim("line") == END_OF_SECTION
    markers = written(lines.where(reduce(or_, map(_starts, tables), is_end)), "markers")
    starts = {table: F.min(F.when(_starts(table), F.col("line_no"))).alias(table) for table in tables}
    found = markers.agg(*starts.values()).first()
    for table in tables:
        if found[table] is None:
            raise ValueError(f"no COPY marker for table {table}")
    position = F.col("line_no")
    ends = {
        table: F.min(F.when(is_end & (position > _literal(found[table], lines)), position)).alias(table)
        for table in tables
    }
    until = markers.agg(*ends.values()).first()
    sections = {}
    for table in tables:
        if until[table] is None:
            raise ValueError(f"no end marker after table {table}")
        inside = (position > _literal(found[table], lines)) & (position < _literal(until[table], lines))
        sections[table] = lines.where(reduce(and_, _leaf_bounds(found[table], until[table]), inside))
    return sections


def _leaf_bounds(start, end) -> list[Column]:
    """Bounds on the parts of a landed position. Parquet keeps statistics per part, not per struct."""
    if not hasattr(start, "asDict"):
        return []
    part = F.col("line_no")
    bounds = [part["file"] >= start.file, part["file"] <= end.file]
    if start.file == end.file:
        bounds += [part["block"] >= start.block, part["block"] <= end.block]
        if start.block == end.block:
            bounds += [part["row"] > start.row, part["row"] < end.row]
    return bounds


def copy_section(lines: DataFrame, table: str) -> DataFrame:
    return copy_sections(lines, [table])[table]


def _literal(value, lines: DataFrame) -> Column:
    """A position read from `lines` as a literal of the same type."""
    if hasattr(value, "asDict"):
        return F.struct(*[F.lit(part).alias(name) for name, part in value.asDict().items()])
    return F.lit(value).cast(lines.schema["line_no"].dataType)


def parse_price_lines(lines: DataFrame) -> DataFrame:
    """Price rows with typed columns and the UTC `date`; unusable rows carry a `reject` reason.

    The line is stripped before it is split, so trailing empty fields vanish and the last field may
    be missing. A missing date is as unusable as an unreadable one.
    """
    schema = T.StructType([T.StructField("date", T.TimestampNTZType()) if f.name == "date" else f for f in PRICE_SCHEMA])
    rows = typed_rows(lines, schema, strip(F.col("line")), MIN_PRICE_FIELDS, {"date": lambda text: parse_utc(strip(text))})
    undated = F.when(F.col("date").isNull(), "date missing")
    return rows.withColumn("reject", F.coalesce("reject", undated))


def parse_station_lines(lines: DataFrame) -> DataFrame:
    """Station rows with the columns of the station extract."""
    return typed_rows(lines, STATION_SCHEMA, F.col("line"), len(STATION_SCHEMA))
