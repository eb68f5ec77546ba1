"""Evidence of what a search found: facts with their records, coverage, the response's subgraph; numbered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import save


def facts(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, id, rel, direction, other, fact): the edges (src, rel, dst, source, row, field) of the chosen (query, id, node), in either
    direction, each once for every record that states it."""
    fact = F.concat_ws(":", "source", F.col("row").cast("string"), "field").alias("fact")
    out = edges.select(F.col("src").alias("node"), "rel", F.lit("OUTGOING").alias("direction"), F.col("dst").alias("other"), fact)
    back = edges.select(F.col("dst").alias("node"), "rel", F.lit("INCOMING").alias("direction"), F.col("src").alias("other"), fact)
    return chosen.join(out.unionByName(back), "node").select("query", "id", "rel", "direction", "other", "fact").distinct()


def coverage(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """(query, selected, with_facts, coverage, all_traceable) of the chosen (query, id) and their facts."""
    counts = found.groupBy("query", "id").agg(F.count("*").alias("facts"))
    has = F.coalesce("facts", F.lit(0)) > 0
    rows = chosen.join(counts, ["query", "id"], "left")
    return rows.groupBy("query").agg(F.count("*").alias("selected"), F.count_if(has).alias("with_facts"), F.avg(has.cast("double")).alias("coverage"), F.bool_and(has).alias("all_traceable"))


def subgraph(chosen: DataFrame, source: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(query, src, rel, dst, origin): edges among at most ``most`` nodes of each query.

    Nodes are the query's source (query, source), then the chosen (query, node, rank, relation, bridge) by rank, then the nodes of their
    paths. Edges are the chosen's inferred relations from the source, and the distinct explicit ones with both ends inside.
    """
    first = source.select("query", F.col("source").alias("node"), F.lit(0).alias("turn"), F.lit(0).alias("rank"))
    second = chosen.select("query", "node", F.lit(1).alias("turn"), "rank")
    third = chosen.select("query", F.explode("bridge").alias("node"), F.lit(2).alias("turn"), "rank")
    turns = first.unionByName(second).unionByName(third).groupBy("query", "node").agg(F.min(F.struct("turn", "rank")).alias("turn"))
    nodes = turns.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("turn", "node"))).filter(F.col("at") <= most).select("query", "node")
    nodes = F.broadcast(save(nodes))  # ``most`` a query
    inferred = chosen.join(source, "query").filter("node <> source").select("query", F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("node").alias("dst"), F.lit("INFERRED").alias("origin"))
    inferred = inferred.join(nodes.withColumnRenamed("node", "src"), ["query", "src"], "left_semi").join(nodes.withColumnRenamed("node", "dst"), ["query", "dst"], "left_semi")
    explicit = edges.join(nodes.withColumnRenamed("node", "src"), "src").join(nodes.withColumnRenamed("node", "dst"), ["query", "dst"], "left_semi")
    explicit = explicit.select("query", "src", "rel", "dst", F.lit("EXPLICIT").alias("origin")).distinct()
    return inferred.select("query", "src", "rel", "dst", "origin").unionByName(explicit)


def numbered(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    """Add ``row``, each row's number in this order from ``start``, by ranges and their counts: no task sees all rows."""
    at = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    sizes = at.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each part
    joined = at.join(F.broadcast(before), "__part")
    return joined.withColumn("row", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("__at", "__part", "__before")


def citable(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, value) of the fields that are not blank, trimmed."""
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.trim(value).alias("value")) for name, value in fields.items()])
    return rows.select(key, F.inline(cells)).filter("value <> ''")
