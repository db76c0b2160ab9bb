"""Writers. Tables are replaced as a whole, run records are appended."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.trees import TreeModel, to_text


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
    order: list[str] | None = None,
) -> None:
    """Parquet table, stored by the given columns, rows of a file in `order` (which begins with these columns).

    Rows of a stored partition are brought together first, so that its number of files follows its size, not
    the number of tasks. Spark splits a large one again (rebalance), so that it is written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# How COPY text escapes the characters that would end a field or a row; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def write_tsv(df: DataFrame, path: str) -> None:
    r"""COPY text with a header in every file: tab-separated, `\N` for NULL, nothing quoted, `\t` for a tab."""
    for name, kind in df.dtypes:
        if kind == "string":
            text = F.col(name)
            for char, escape in ESCAPES:
                text = F.replace(text, F.lit(char), F.lit(escape))
            df = df.withColumn(name, text)
    df.write.mode("overwrite").csv(
        path,
        sep="\t",
        header=True,
        nullValue="\\N",
        emptyValue="",
        quote="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_run(record: DataFrame, path: str) -> None:
    """Append run records, stamped with the time of the run."""
    record.withColumn("run_at", F.current_timestamp()).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_model_text(spark: SparkSession, model: TreeModel, path: str) -> None:
    """One text file in the public format of tree models, through Spark's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place, True)
    try:
        stream.write(bytearray(to_text(model).encode()))
    finally:
        stream.close()
