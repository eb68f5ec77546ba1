"""The corpus pipeline: language, quality, near-duplicates, mixture, packing. Each stage calls one operator of tessera.llm.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, packing, quality, simhash
from tessera.llm.common import save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without letters and those of uncertain language go."""
    return langid.accepted(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier scores from its threshold on. All labels may train it here."""
    positives = quality.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", F.lit(True))
    return quality.score(docs, quality.train(docs, positives), keep_from=quality.THRESHOLD)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash, that with the smallest doc_id; see simhash.keep_one."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    import public_tokenizers

    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("quality", good),
    ("near-duplicates", unique),
    ("mixture", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifiers nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the place of every piece of every document that stays.

    Null and empty texts go in the first stage, which can't tell their language. Documents that repeat each other count
    once from the third stage on, until the mixture repeats what it wants more of. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
