"""Readers of landed files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.operators.means import skip_first_day
from pricetide.operators.trees import TreeModel, from_text
from pricetide.schemas import OIL_SCHEMA, PRICE_SCHEMA, STATION_SCHEMA
from pricetide.sources.rows import typed_rows


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    r"""Tab-separated file with a header: `\N` is NULL, quotes and words such as NA are plain text.

    Rows keep their text and a `reject` reason; `accepted` and `rejected` part them.
    """
    header = "\t".join(schema.names)
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line") != header)
    return typed_rows(lines, schema, F.col("line"), len(schema))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price file; the date stays text until `parse_dates`."""
    return read_tsv(spark, path, PRICE_SCHEMA)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, STATION_SCHEMA)


def read_oil(spark: SparkSession, path: str, skip_first: bool = True) -> DataFrame:
    """Daily oil closes from a CSV with header; the first day of a download is skipped."""
    oil = spark.read.schema(OIL_SCHEMA).csv(path, header=True)
    return skip_first_day(oil) if skip_first else oil


def flatten_stations(documents: DataFrame, text: str, station: T.StructType, levels: int = 1) -> DataFrame:
    """Station list documents (JSON text) to one row per station.

    Up to `levels` levels of nested structs become `outer.inner` columns; deeper ones stay structs.
    """
    schema = T.StructType([T.StructField("stations", T.ArrayType(station))])
    stations = documents.select(F.explode(F.from_json(text, schema)["stations"]).alias("s")).select("s.*")
    return flatten(stations, levels)


def flatten(rows: DataFrame, levels: int = 1) -> DataFrame:
    """Nested struct fields as top-level columns named `outer.inner`."""
    for _ in range(levels):
        columns = []
        for field in rows.schema.fields:
            name = f"`{field.name}`"
            if isinstance(field.dataType, T.StructType):
                columns += [
                    F.col(f"{name}.`{inner}`").alias(f"{field.name}.{inner}") for inner in field.dataType.names
                ]
            else:
                columns.append(F.col(name))
        rows = rows.select(*columns)
    return rows


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def read_model_text(spark: SparkSession, path: str) -> TreeModel:
    """A model from a text file in the public format, wherever Spark can read it; a model is read whole."""
    return from_text(spark.read.text(path, wholetext=True).first().value)
