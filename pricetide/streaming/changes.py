"""Change labels on a stream: a record is labelled when the station's next record arrives.

Each micro-batch is joined to the open records (the last record of every station so far) and labelled
with the batch operator, so a busy station is sliced there as well. A stateful operator would bring all
of a station's records to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetide.operators import prices as pr
from pricetide.session import own_scratch, remove_path

COLUMNS = ["id", "uuid", "date", "diesel"]


def _last_records(records: DataFrame) -> DataFrame:
    """Newest record of every station; combines on the map side."""
    newest = F.max_by(F.struct(*COLUMNS), F.struct("date", "id"))
    return records.where("uuid IS NOT NULL").groupBy("uuid").agg(newest.alias("_r")).select("_r.*")


def placed_batch(batch: DataFrame, open_records: DataFrame | None) -> DataFrame:
    """Records of a batch with `late`: whether they are not newer than their station's open record."""
    fresh = batch.select(*COLUMNS)
    if open_records is None:
        return fresh.withColumn("late", F.lit(False))
    newest = open_records.select("uuid", F.col("date").alias("_date"), F.col("id").alias("_id"))
    placed = fresh.join(newest, "uuid", "left")
    is_late = F.coalesce(F.struct("date", "id") <= F.struct("_date", "_id"), F.lit(False))
    return placed.select(*COLUMNS, (F.col("_date").isNotNull() & is_late).alias("late"))


def label_batch(placed: DataFrame, open_records: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Labelled records, and records that are open now, of the placed records that are not late."""
    fresh = placed.where("NOT late").select(*COLUMNS)
    if open_records is not None:
        fresh = fresh.unionByName(open_records)
    followed = pr.with_next(fresh, {"id": "_next_id", "diesel": "diesel_shift"})
    closed = followed.where(F.col("_next_id").isNotNull()).drop("_next_id").transform(pr.with_change_label)
    return closed, _last_records(fresh)


def corrections(records: DataFrame, late: DataFrame) -> DataFrame:
    """Labels of late records and of the records before them, from all records of their stations so far."""
    stations = late.select("uuid").where("uuid IS NOT NULL").distinct()
    new = late.select(F.col("id").alias("_late")).distinct()
    history = records.select(*COLUMNS).join(stations, "uuid", "left_semi").select(*COLUMNS)
    followed = pr.with_next(history, {"id": "_next_id", "diesel": "diesel_shift"}).where("_next_id IS NOT NULL")
    is_late = followed.join(new, F.col("id") == F.col("_late"), "left_semi")
    before = followed.join(new, F.col("_next_id") == F.col("_late"), "left_semi")
    return is_late.unionByName(before).distinct().drop("_next_id").transform(pr.with_change_label)


def start(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the labelling of a price stream (`id uuid date diesel`) into tables under `root`.

    Tables are written per batch number and replaced when a batch is repeated, so a restart after a lost
    driver gives every label once. A batch is read once, into `records`. The open records of batch n are read
    by batch n + 1; older ones are removed. A late record gets its label, and corrects that of the record
    before it; `read_labels` gives the newest label of every record.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with own_scratch(batch.sparkSession):
            label(batch, number)

    def label(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{root}/open/batch={number - 1}") if number else None
        placed_batch(batch, before).write.mode("overwrite").parquet(f"{root}/records/batch={number}")
        placed = spark.read.parquet(f"{root}/records/batch={number}")
        closed, still_open = label_batch(placed, before)
        late = placed.where("late")
        if not late.isEmpty():
            known = spark.read.parquet(f"{root}/records").where(F.col("batch") <= number)
            closed = closed.unionByName(corrections(known, late))
        closed.write.mode("overwrite").parquet(f"{root}/labels/batch={number}")
        still_open.write.mode("overwrite").parquet(f"{root}/open/batch={number}")
        if number > 1:
            remove_path(spark, f"{root}/open/batch={number - 2}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """The newest label of every labelled record. Records without an id keep all their labels."""
    labels = spark.read.parquet(f"{root}/labels")
    named = [name for name in labels.columns if name not in ("id", "batch")]
    newest = F.max_by(F.struct(*named), "batch").alias("_l")
    known = labels.where("id IS NOT NULL").groupBy("id").agg(newest).select("id", "_l.*")
    return known.unionByName(labels.where("id IS NULL").select("id", *named)).select(*labels.drop("batch").columns)
