"""Text cleaning and strict parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that counts as white space in Unicode; the last one is the ideographic space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Remove any Unicode white space at both ends (`trim` alone removes only spaces)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_category(text: Column) -> Column:
    """Category spelling: stripped, upper case with full case mapping."""
    return F.upper(strip(text))


def null_marker(text: Column) -> Column:
    r"""The dump writes a missing value as `\N`."""
    return F.nullif(text, F.lit("\\N"))


def to_int(text: Column) -> Column:
    """Whole number from decimal text, NULL where the text is no number."""
    return text.try_cast("double").try_cast("int")


def parse_utc(text: Column) -> Column:
    """Strict `yyyy-MM-dd HH:mm:ss` with a UTC offset, as a UTC wall-clock timestamp.

    Accepts `+02`, `+0200`, `+02:00` and `Z`. Fractions, bare dates and missing offsets give NULL,
    which `cast` would let through.
    """
    instant = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssx")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
    )
    return utc_wall_clock(instant)


def utc_wall_clock(instant: Column) -> Column:
    """Zone-free UTC timestamp of an instant, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)
