"""As-of joins: the last known value of a series at the moment of each record."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.frames import FEWEST_ROWS, placed


def attach_last(
    records: DataFrame,
    series: DataFrame,
    values: list[str],
    at: str = "date",
    by: list[str] | None = None,
    fewest: int = FEWEST_ROWS,
) -> DataFrame:
    """Left join with the last row of `series` not after a record's moment `at`, among those with the same `by`.

    Adds the columns `values`, which must not be in `records` yet. A row of the series at the very moment counts. Of
    several rows at one moment the one with the greatest values counts; a NULL value is taken like any other. Rows of
    the series without a moment or a key are left out; records without one, or before the first row, get NULLs.

    Records and series are put in one global order and cut into even parts, wherever a key or a gap begins or ends. A
    part looks back over its own rows only and takes over the last row of the series from the parts before it, of which
    there is one per part. So neither a busy key nor a busy hour is a group of one task.
    """
    by = by or []
    taken = set(values) & set(records.columns)
    if taken:
        raise ValueError(f"columns already in the records: {sorted(taken)}")
    whole = reduce(and_, [F.col(name).isNotNull() for name in [*by, at]])
    value, tick = F.max(F.struct(*values)).alias("_value"), F.struct(*by, "_value")
    ticks = series.where(whole).groupBy(*by, at).agg(value).withColumn("_tick", tick).drop("_value")
    rows = records.select(*by, at, F.struct(*records.columns).alias("_record"))
    both = ticks.unionByName(rows, allowMissingColumns=True)
    ordered = placed(both, [*by, at, F.col("_record").isNotNull()], fewest=fewest)

    so_far = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ordered.groupBy("_part").agg(F.max_by("_tick", F.when(F.col("_tick").isNotNull(), F.col("_pos"))).alias("_end"))
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    met = ordered.withColumn("_seen", F.last("_tick", ignorenulls=True).over(so_far))
    met = met.join(F.broadcast(carried), "_part").where("_record IS NOT NULL")  # one row per part
    last = F.coalesce("_seen", "_carried")
    same = reduce(and_, [F.col(name) == last[name] for name in by], F.col(at).isNotNull())
    found = [F.when(same, last["_value"][name]).alias(name) for name in values]
    return met.select("_record.*", *found)
