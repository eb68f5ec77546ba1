"""Sources: the supplied tables as typed nodes and edges with provenance, and readers for CSV and JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: label: (table, id column, title column, id prefix)
NODES = {
    "Region": ("region", "r_regionkey", "r_name", "RG"),
    "Nation": ("nation", "n_nationkey", "n_name", "NT"),
    "Customer": ("customer", "c_custkey", "c_name", "CU"),
    "Supplier": ("supplier", "s_suppkey", "s_name", "SU"),
    "Part": ("part", "p_partkey", "p_name", "PT"),
    "Order": ("orders", "o_orderkey", "o_orderstatus", "OR"),
}
#: relationship: (table, source prefix, source column, target prefix, target column)
EDGES = {
    "IN_REGION": ("nation", "NT", "n_nationkey", "RG", "n_regionkey"),
    "LIVES_IN": ("customer", "CU", "c_custkey", "NT", "c_nationkey"),
    "BASED_IN": ("supplier", "SU", "s_suppkey", "NT", "s_nationkey"),
    "PLACED_BY": ("orders", "OR", "o_orderkey", "CU", "o_custkey"),
    "CONTAINS": ("lineitem", "OR", "l_orderkey", "PT", "l_partkey"),
    "SUPPLIES": ("lineitem", "SU", "l_suppkey", "PT", "l_partkey"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(NODES)) -> DataFrame:
    """(id, label, title, source); a blank title falls back to the id."""
    parts = []
    for label in labels:
        name, key, title, prefix = NODES[label]
        own = identifier(prefix, key)
        parts.append(table(spark, sf_dir, name).select(own.alias("id"), F.lit(label).alias("label"), F.coalesce(F.nullif(F.trim(F.col(title)), F.lit("")), own).alias("title"), F.lit(name).alias("source")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(EDGES)) -> DataFrame:
    """(src, rel, dst, source), one row for each source row; blank foreign keys give none."""
    parts = []
    for rel in kinds:
        name, sp, sc, dp, dc = EDGES[rel]
        rows = table(spark, sf_dir, name).filter(F.col(sc).isNotNull() & F.col(dc).isNotNull())
        parts.append(rows.select(identifier(sp, sc).alias("src"), F.lit(rel).alias("rel"), identifier(dp, dc).alias("dst"), F.lit(name).alias("source")))
    return reduce(DataFrame.unionByName, parts)


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, dst, source, row, field): a document describes the order of its number and cites the document of half its number.

    Edges whose other end is missing are left out, and a document does not cite itself.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id")
    row = (F.col("doc_id") + 2).alias("row")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    one = docs.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(identifier("DO", "doc_id").alias("src"), F.lit("DESCRIBES").alias("rel"), identifier("OR", "o_orderkey").alias("dst"), row, F.lit("order").alias("field"))
    half = docs.filter("doc_id > 0").withColumn("cited", F.expr("doc_id div 2"))
    two = half.join(docs.select(F.col("doc_id").alias("cited")), "cited", "left_semi").select(identifier("DO", "doc_id").alias("src"), F.lit("CITES").alias("rel"), identifier("DO", "cited").alias("dst"), row, F.lit("cited").alias("field"))
    return one.unionByName(two).withColumn("source", F.lit("documents")).select("src", "rel", "dst", "source", "row", "field")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, quoted fields over several lines."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines raise."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")
