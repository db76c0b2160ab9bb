"""The corpus pipeline: documents in, sharded training documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricetide.llm import toxicity
from pricetide.llm.common import read, written
from pricetide.llm.decontaminate import remove_contaminated
from pricetide.llm.jaccard_join import jaccard_join, without_ids
from pricetide.llm.mixing import mixed
from pricetide.llm.sharding import shard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the labels of the given documents are learnt."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.remove_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies; rows without an id stay."""
    classes = jaccard_join(docs)
    return without_ids(docs, classes.where("doc_id <> component_id").select("doc_id").distinct())


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document of the mix: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_test_items),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]
#: SQL has neither the nearest-neighbour scores nor the shard digests; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
