"""What the operators share: tables in the shared folder, joins that stand hot keys, a distributed row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import save, scratch  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than this.
HOT_SHARE = 1000
#: Rows and bytes that Python gets at a time, at most (a longer text comes alone).
BATCH, BATCH_BYTES = 500, 1 << 22


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, facts: DataFrame, key: str, spread: list[Column], count: str = "n") -> DataFrame:
    """Left join of many rows to one row of facts per key.

    ``facts`` must be a saved table; its column ``count`` says how many of ``rows`` have the key. Keys with more
    than one in HOT_SHARE rows are fewer than HOT_SHARE, so their facts are broadcast; their rows, and those of the
    null key, which joins nothing, are dealt out over all tasks by a hash of ``spread``. One shuffle of ``rows``.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    names = [c for c in facts.columns if c != key]
    mine = "attach"
    while any(c.lower().startswith(mine) for c in rows.columns):
        mine = f"_{mine}"  # no column of rows starts like the names used here
    at = F.col(f"`{key}`")
    hot = facts.filter(F.col(count) * HOT_SHARE > F.lit(total)).filter(at.isNotNull())
    hot = hot.select(at.alias(f"{mine}_hot"), *[F.col(c).alias(f"{mine}_h{i}") for i, c in enumerate(names)])
    keep = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.join(F.broadcast(hot), at == F.col(f"{mine}_hot"), "left")
    aside = F.col(f"{mine}_hot").isNotNull() | at.isNull()
    rows = rows.withColumn(f"{mine}_salt", F.when(aside, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    cold = facts.filter(at.isNotNull()).select(at.alias(f"{mine}_cold"), F.lit(0).cast("long").alias(f"{mine}_none"), *[F.col(c).alias(f"{mine}_c{i}") for i, c in enumerate(names)])
    joined = rows.join(cold, (at == F.col(f"{mine}_cold")) & (F.col(f"{mine}_salt") == F.col(f"{mine}_none")), "left")
    return joined.select(*keep, *[F.coalesce(f"{mine}_h{i}", f"{mine}_c{i}").alias(c) for i, c in enumerate(names)])


def ordered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, each row's place from 0 in the global order, without one task that sees all rows.

    Rows are range-partitioned and sorted; a row's place is its place in its partition plus the sizes of the
    partitions before it. The only global step is a running sum with one row per partition.
    """
    n = partitions(df.sparkSession)
    at = save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = at.join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with bounded batches: texts are long, and a task holds a batch in the JVM and in Python.

    Spark reads the bounds when the plan runs, so they stay set for the session; smaller ones are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        now = int(str(now).rstrip("b")) if now and str(now).rstrip("b").lstrip("-").isdigit() else -1
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(function, schema)


def unused(names: list[str], wanted: str) -> str:
    """``wanted`` with as many underscores in front as make it a name not among ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns: what stands for a row where a decision on it is joined back."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
