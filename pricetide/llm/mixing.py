"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import WORD, written

#: Weights of the sources in code point order, repeating; a NULL source comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the input, and most copies of a document in it.
SHARE = 1.5
MOST_COPIES = 2
#: Rows that one window partition holds, about; partitions are cut by key, so this changes no result.
WINDOW_ROWS = 1_000


def source_targets(sized: DataFrame, share: float = SHARE, copies: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size, target): words that each source is to give.

    Sources share `share` times all words by weight, but none gives more than `copies` times its own; what
    that leaves over is shared by the others, by weight. This is a water level: with the sources ordered by
    cap / weight, the level of the first source that stays below its cap is everyone's level. One row per
    source passes through one task.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    place = F.row_number().over(by_name) - 1
    rows = sizes.select(
        "source",
        "source_size",
        F.element_at(weights, (place % len(WEIGHTS) + 1).cast("int")).cast("double").alias("weight"),
        (F.lit(copies) * F.col("source_size")).cast("double").alias("cap"),
    )
    by_level = Window.orderBy(F.expr("cap / weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(everywhere)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.expr("cap / weight"), F.col("level"))).over(everywhere)
    target = F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def fair_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    copies: int = MOST_COPIES,
) -> DataFrame:
    """How often the mix takes each document.

    One row per row of `docs`: `doc_id`, `source`, `size` (words), `source_size`, `target` of its source,
    `copies` (0 to `copies`), `taken` (words taken, repeats counted) and `finish` (virtual finish time of the
    first copy). Documents of a source are shuffled by a digest of their id, so reruns agree; every further
    copy comes after all documents had their turn. A copy's finish time is the words of its source so far
    divided by the source's target. All copies in the order of finish time are taken until the budget, the
    sum of the targets, would be exceeded. NULL and empty texts have size 0. Sources of size 0 have target 0
    and give nothing. Ties are ordered by source, digest and id; rows that agree in all of these are alike.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        ),
        "sized",
    )
    targets = written(source_targets(sized, share, copies), "targets")
    rows = sized.count()
    cuts = max(1, min(1 << 16, ceil(rows / WINDOW_ROWS)))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * cuts / (1 << 32))
    sized = sized.withColumn("part", part)

    same_source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("queue")
    sized, targets = sized.withColumn("queue", same_source), targets.withColumn("queue", same_source).drop("source")
    sums = sized.groupBy("queue", "part").agg(F.sum("size").alias("part_size"))
    until = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("queue", "part", F.coalesce(F.sum("part_size").over(until), F.lit(0)).alias("offset"))
    in_part = Window.partitionBy("queue", "part").orderBy("key", "doc_id", "size")
    served = F.sum("size").over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    queued = (
        sized.withColumn("served", served)
        .join(offsets, ["queue", "part"])
        .join(targets, "queue")
        .withColumn("served", F.col("served") + F.col("offset"))
    )
    queued = written(queued, "queued")

    finish = (F.col("served") + F.col("turn") * F.col("source_size")) / F.col("target")
    turns = F.explode(F.array(*[F.lit(i).cast("long") for i in range(copies)])).alias("turn")
    asked = queued.where("target > 0").select("*", turns).withColumn("finish", finish)
    asked = asked.select("finish", "queue", "key", "doc_id", "size", "turn")
    steps = max(1, min(4096, ceil(copies * rows / WINDOW_ROWS)))
    asked = asked.withColumn("step", F.floor(F.col("finish") * steps))
    budget = targets.agg(F.sum("target").alias("budget"))
    loads = asked.groupBy("step").agg(F.sum("size").alias("load")).crossJoin(F.broadcast(budget))
    ordered = Window.orderBy("step")
    loads = loads.select(
        "step", "budget", (F.sum("load").over(ordered) - F.col("load")).alias("start"), F.sum("load").over(ordered).alias("end")
    )
    # 1e-9: the targets' sum may miss the exact budget by rounding.
    last = loads.where("end > budget + 1e-9 * budget").agg(F.min_by(F.struct("*"), "step").alias("l")).select("l.*")
    in_step = Window.orderBy("finish", "queue", "key", "doc_id", "size", "turn")
    so_far = F.sum("size").over(in_step.rowsBetween(Window.unboundedPreceding, 0))
    over = (
        asked.join(F.broadcast(last), "step")
        .withColumn("total", F.col("start") + so_far)
        .where("total > budget + 1e-9 * budget")
        .agg(F.min(F.struct("finish", "queue", "key", "doc_id", "size", "turn")).alias("cut"))
    )
    result = queued.crossJoin(F.broadcast(over))
    taken = F.lit(0)
    for turn in range(copies):
        at = (F.col("served") + F.lit(turn) * F.col("source_size")) / F.col("target")
        own = F.struct(
            at.alias("finish"), "queue", "key", "doc_id", "size", F.lit(turn).cast("long").alias("turn")
        )
        taken = taken + F.when((F.col("target") > 0) & (F.col("cut").isNull() | (own < F.col("cut"))), 1).otherwise(0)
    result = result.withColumn("copies", taken)
    return result.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("target") > 0, F.col("served") / F.col("target")).alias("finish"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; rows with the same id follow the one taken most."""
    taken = fair_mix(docs, id_col, **options).groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    taken = taken.where("_copies > 0").withColumnRenamed("doc_id", "_id")
    often = docs.join(taken, F.col(id_col).eqNullSafe(F.col("_id")))
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
