"""Registered queries of this subpackage, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import alignment, brown_lm, chat, decontaminate, fingerprints, language, licenses, periodic, quality, toxicity
from pricetide.llm.common import read, written
from pricetide.llm.jaccard_join import jaccard_join
from pricetide.llm.mixing import fair_mix
from pricetide.llm.sharding import shard

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with 80 % equal five-word shingles."""
    return jaccard_join(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of documents and of their edited texts."""
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses among the texts and lines of documents."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    return shard(read(spark, sf_dir, "documents"), 8)


def op5_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class n-gram scores of all documents."""
    return brown_lm.fit_score(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the edit distance."""
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the formatted conversations; conversation -1 consists of control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT -1L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)",
        args={"text": text},
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    texts = written(chat.formatted(chat.canonical_turns(rows, "conv_id")), "chats")
    chars = texts.select(F.col("conv_id").alias("own_id"), F.length("formatted").alias("chars"))
    back = chat.read_back(texts)
    back = back.join(chars, F.col("conv_id").eqNullSafe(F.col("own_id")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by weak labels and a hashed linear scorer."""
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    mix = fair_mix(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by their nearest labelled examples."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.toxicity(docs, index)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which is made to repeat."""
    found = periodic.periodic_runs(read(spark, sf_dir, "documents"), edit=periodic.repeated)
    return periodic.run_digests(found)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by their character n-grams."""
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op13_token_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Links and groups of the tokens of two tokenizers in all documents."""
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)).alias("groups_sha256")
    docs = read(spark, sf_dir, "documents")
    return alignment.align(docs, f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model", told=digest)


QUERIES = {
    query.__name__: query
    for query in (
        op1_jaccard_join,
        op2_fingerprints,
        op3_licenses,
        op4_sharding,
        op5_brown_scores,
        op6_decontamination,
        op7_chat,
        op8_quality,
        op9_mixing,
        op10_toxicity,
        op11_periodic_runs,
        op12_language_id,
        op13_token_alignment,
    )
}
