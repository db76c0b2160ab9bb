"""Rows of COPY text: tab-separated fields, the null marker, nothing quoted.

The CSV reader is not used: it takes empty text for NULL or a quote for a quoted field, and whether it
finds a row malformed depends on the columns a query happens to select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.text import null_marker


# Escapes of COPY text besides the doubled backslash.
ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\b": "\b", "\\f": "\f", "\\v": "\v"}


def unescaped(field: Column) -> Column:
    """A field of COPY text as it was before it was escaped."""

    def plain(part: Column) -> Column:
        for escape, char in ESCAPES.items():
            part = F.replace(part, F.lit(escape), F.lit(char))
        return part

    parts = F.transform(F.split(field, r"\\\\"), plain)
    return F.when(F.contains(field, F.lit("\\")), F.array_join(parts, "\\")).otherwise(field)


def typed_rows(
    lines: DataFrame, schema: T.StructType, text: Column, min_fields: int, parsers: dict | None = None
) -> DataFrame:
    """Columns of `schema` from the tab-separated `text`, the raw `line`, and `reject`.

    `reject` is the reason why a row cannot be used: too few or too many fields, or a field that does
    not fit its type. `parsers` replace the plain cast of a column.
    """
    split = lines.withColumn("_fields", F.split(text, "\t"))
    raw = {field.name: unescaped(null_marker(F.get("_fields", F.lit(i)))) for i, field in enumerate(schema.fields)}
    casts = {field.name: lambda value, to=field.dataType: value.try_cast(to) for field in schema.fields}
    typed = {name: (parsers or {}).get(name, casts[name])(value) for name, value in raw.items()}
    reject = F.when(F.size("_fields") < min_fields, "too few fields")
    reject = reject.when(F.size("_fields") > len(raw), "too many fields")
    for name, value in typed.items():
        reject = reject.when(raw[name].isNotNull() & value.isNull(), f"{name} not readable")
    return split.select("line", *[value.alias(name) for name, value in typed.items()], reject.alias("reject"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject").isNull()).drop("reject", "line")


def rejected(rows: DataFrame) -> DataFrame:
    """Lines that could not be used, with the reason."""
    return rows.where(F.col("reject").isNotNull()).select("line", "reject")
