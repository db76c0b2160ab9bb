"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

SETTINGS = {
    # Calendar fields are UTC fields, so the session zone is part of the results.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # AQE measures a join side before it is broadcast and splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# On a cluster shuffles begin with many partitions, which AQE merges to fit what arrives.
CLUSTER_SETTINGS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}


def build_session(app: str = "pricetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        for key, value in CLUSTER_SETTINGS.items():
            if key not in conf:
                spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that every executor can reach.

    It is the folder the cluster names in `spark.checkpoint.dir`. Only a local session without
    one gets a temporary folder: on a cluster that would be one machine's disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pricetide-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return context.getCheckpointDir()


_OWNED: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end: results must be written by then."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file system, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
