"""Mixing sources to target weights: repetition rates by source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, attach, ordered, save, unused

#: Weights of the sources in code point order, repeating; targets stop at CAP times a source's size.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Target words per source from ``sizes`` (source, size, n): one row per source with source_size and target.

    Sources in code point order, the null source last, weigh ``weights``, repeating. They share ``share`` of all
    sizes by weight; a target stops at ``cap`` times its source's size and the excess is reshared among the others
    by weight until none is above. Each round is one aggregation over the sources: only three numbers reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    at = ordered(by, [F.col("source").isNull(), F.col("source")], "__index")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__index") % len(weights) + 1).cast("int"))
    at = save(at.withColumn("__weight", weight.cast("long")).withColumn("__most", F.col("source_size") * F.lit(cap)))
    total, weighed = at.agg(F.sum("source_size"), F.sum("__weight")).first()
    level, full = (total or 0) * share / (weighed or 1), 0
    while True:
        above = F.col("__most") < F.lit(float(level)) * F.col("__weight")
        most, w, n = at.agg(F.sum(F.when(above, F.col("__most"))), F.sum(F.when(above, F.col("__weight"))), F.count(F.when(above, 1))).first()
        if n == full or w == weighed:
            break
        level, full = ((total or 0) * share - most) / (weighed - w), n
    target = F.least(F.col("__most").cast("double"), F.lit(float(level)) * F.col("__weight"))
    return at.select("source", "source_size", target.alias("target"), "n")


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(sized: DataFrame, id_col: str, seed: int = SEED, **how) -> DataFrame:
    """Rows (``id_col``, source, size) with source_size, target and ``copies``, the times the mix takes each.

    The rate is target / source_size: floor(rate) copies, and one more if the row's draw is below the fraction. Rows
    that repeat an id share its draw. A source without words has target 0 and copies 0. Empty table: no rows.
    """
    sized = save(sized.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    facts = targets(sized.select("source", "size"), **how).withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    joined = attach(sized, save(facts), "__key", [F.col(id_col), F.col("size")])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(seed, F.col(id_col)) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("__key", "n")


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each row as often as the plan takes it.

    The rate depends on the source alone, so rows meet one row per source; texts are shuffled once. Null texts count
    no words; null sources are one source, the last. Rows that repeat an id, and those of the null id, share its draw. A column of
    docs may have any name, ``size`` and ``target`` included. Empty table: no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, rate, times, copy = (unused(docs.columns, c) for c in ("mix_key", "mix_rate", "mix_copies", "mix_copy"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    facts = targets(save(docs.select("source", words(F.col("text")).alias("size"))), **how)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    count = unused(docs.columns, "mix_n")
    facts = save(facts.select(named.alias(key), share.alias(rate), F.col("n").alias(count)))
    rows = attach(docs.withColumn(key, named), facts, key, [F.col("doc_id")], count=count)
    copies = F.floor(rate) + (draw(seed, F.col("doc_id")) < F.col(rate) - F.floor(rate)).cast("long")
    rows = rows.withColumn(times, copies.cast("int")).filter(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; nulls, repeats and empty tables as in ``mix``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = plan(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "doc_id")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
c AS (SELECT *, 3.0 * source_size / weight AS ratio, (SELECT sum(source_size) FROM s) AS total FROM w),
r AS (SELECT *, CAST((total - coalesce((SELECT sum(3 * o.source_size) FROM c o WHERE o.ratio < c.ratio), 0)) AS DOUBLE)
             / (SELECT sum(o.weight) FROM c o WHERE o.ratio >= c.ratio) AS level FROM c),
l AS (SELECT CAST(any_value(total) - coalesce(sum(3 * source_size) FILTER (ratio < level), 0) AS DOUBLE)
             / nullif(sum(weight) FILTER (ratio >= level), 0) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN r.ratio < r.level THEN CAST(3 * source_size AS DOUBLE) ELSE coalesce(l.level * weight, 0) END AS target FROM r, l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
