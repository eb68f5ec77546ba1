"""Resumable embedding: only documents whose (id, text hash) has no vector yet are embedded, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def pending(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (id, text) without a vector for their present text in ``known`` (id, text_sha256)."""
    return hashed(docs).join(known.select("id", "text_sha256"), ["id", "text_sha256"], "left_anti")


def follow(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that embeds each micro-batch's pending documents and appends them to the Parquet table at ``path``.

    ``embed`` maps (id, text, text_sha256) to those columns with a vector. A batch repeated after a failure finds its rows
    written and adds none; repeated rows within a batch count once.
    """
    spark = stream.sparkSession
    empty = embed(hashed(spark.createDataFrame([], stream.select("id", "text").schema)))
    empty.write.mode("append").parquet(path)
    schema = empty.schema

    def step(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema(schema).parquet(path)
        fresh = pending(batch.select("id", "text").distinct(), known)
        embed(fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
