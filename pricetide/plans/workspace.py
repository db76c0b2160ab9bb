"""Where the jobs keep their tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Workspace:
    """Tables and models under one root, which must be storage shared by all executors."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def prices(self) -> DataFrame:
        """Usable price records; partition pruning leaves the rejected rows out."""
        return self.read("price_rows").where("usable = 1").drop("usable", "reject", "line")

    @property
    def price_rejects(self) -> DataFrame:
        return self.read("price_rows").where("usable = 0").select("line", "reject")
