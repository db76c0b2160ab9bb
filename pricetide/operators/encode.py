"""Category dictionaries: sorted codes 0..n-1, missing and unseen values as code n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.text import clean_category, strip
from pricetide.operators.frames import with_global_index, written

# How the encoded columns are spelled before they are looked up.
SPELLING = {"brand": clean_category, "uuid": strip}


def spelled(column: str) -> Column:
    return SPELLING.get(column, strip)(F.col(column))


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """Dictionary (value, code) of a column's distinct values in sorted order.

    Raw values are made distinct before they are spelled, so spelling does not run per row. The
    dictionary is a written table: it may outgrow the driver, and its size is known when it is joined.
    Its values are written before they are numbered: that counts and samples them, and the rows are read once.
    """
    raw = rows.select(column).distinct()
    values = raw.select(spelled(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_global_index(written(values, "dictionary"), ["value"], "code", unique=True)


def encode(rows: DataFrame, codes: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Replace (or add as `name`) the code of a column; missing and unseen values get the code n."""
    unknown = codes.count()
    lookup = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return (
        rows.join(lookup, spelled(column) == F.col("_value"), "left")
        .withColumn(name or column, F.coalesce("_code", F.lit(unknown)).cast("int"))
        .drop("_value", "_code")
    )
