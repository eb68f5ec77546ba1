"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, ordered, partitions, save, text_or_empty, unused


def interleave(df: DataFrame, stratum: str, shards: int, seed: int, columns: list[str]) -> DataFrame:
    """Deal rows into shards that each hold every stratum in the mixture's proportion.

    Rows are shuffled within their stratum by a seeded MD5 of ``columns`` and ranked there; a row of rank r among n
    gets the fraction (r + 1/2) / n. All rows are sorted by fraction and cut into ``shards`` runs of equal length,
    so a stratum's count in a shard is within about one of its share. Both orders are range-partitioned sorts: a
    stratum with a third of all rows is spread over a third of the tasks.

    Returns ``columns`` and the stratum with ``shard`` (from 0) and ``slot`` (its place there, from 0). Null strata
    are a stratum of their own; repeated rows all get places of their own (which of them gets which is open, and
    can't be told apart); an empty table gives no rows; ``df`` must not have columns shard and slot among ``columns``. Law: shards' counts
    are at most one apart.
    """
    names = list(dict.fromkeys([stratum, *columns]))
    key, mixed, first, of, start, fraction, place = (unused([*df.columns, "shard", "slot"], c) for c in ("stratum_key", "shuffled", "first_in", "of_all", "start_at", "fraction", "place"))
    ties = [F.col(f"`{c}`") for c in columns]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    rows = rows.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")))
    cells = [F.coalesce(c.cast("string"), F.lit("null")) for c in ties]
    rows = rows.withColumn(mixed, F.md5(F.concat_ws(":", F.lit(str(seed)), *cells).cast("binary")))
    ranked = save(ordered(rows, [F.col(key), F.col(mixed), *ties], first))
    facts = save(ranked.groupBy(key).agg(F.count("*").alias(of), F.min(first).alias(start)))
    total = facts.agg(F.sum(of)).first()[0] or 0
    placed = attach(ranked, facts, key, [F.col(first)], count=of)
    placed = placed.withColumn(fraction, (F.col(first) - F.col(start) + 0.5) / F.col(of))
    placed = ordered(placed.drop(first, start, of), [F.col(fraction), F.col(mixed), F.col(key), *ties], place)
    shard = F.expr(f"({place} * {shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    begin = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", (F.col(place) - begin).cast("long")).select(*[F.col(f"`{c}`") for c in names], "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write each shard's rows, in slot order, below a folder of its own; a shard spans as many files as it needs."""
    n = partitions(df.sparkSession)
    df.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law of rows (counts at most one apart). Null texts are empty; the rest as in ``interleave``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", "source", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = interleave(rows, "source", 8, 20, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
