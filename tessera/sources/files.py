"""Files of a dataset: its folder, manifests, Markdown, typed documents, embedding artifacts and small JSON reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from .tables import read_json_lines


def _place(spark: SparkSession, path: str):
    """The Hadoop path and its file system, so that any store Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discover(spark: SparkSession, start: str, wanted: tuple[str, ...], variable: str = "TESSERA_DATA") -> str:
    """The folder that holds all ``wanted`` names: the one the environment variable names, else ``start``, else the only one in it.

    None or several raise, and so does a named folder without them.
    """
    named = os.environ.get(variable)
    at, files = _place(spark, named or start)

    def holds(folder) -> bool:
        return all(files.exists(folder.suffix(f"/{name}")) for name in wanted)

    if files.exists(at) and holds(at):
        return at.toString()
    below = [] if named or not files.exists(at) else [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    found = sorted(p.toString() for p in below if holds(p))
    if len(found) != 1:
        raise ValueError(f"{len(found)} folders with {', '.join(wanted)} at {named or start}: {found}")
    return found[0]


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, declared): the record_counts of every dataset_manifest*.json below ``root``; one that is no JSON raises."""
    options = {"multiLine": True, "mode": "FAILFAST", "recursiveFileLookup": True, "pathGlobFilter": "dataset_manifest*.json"}
    rows = spark.read.schema("record_counts map<string, long>").options(**options).json(root)
    return rows.select(_relative(spark, root).alias("file"), F.explode("record_counts").alias("name", "declared"))


def markdown(spark: SparkSession, catalog: DataFrame, root: str, column: str = "path") -> DataFrame:
    """``catalog`` with ``text``, the whole file its ``column`` names relative to ``root``; null where that is absent or empty."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.md").text(root, wholetext=True)
    return catalog.join(files.select(_relative(spark, root).alias(column), F.col("value").alias("text")), column, "left")


def _relative(spark: SparkSession, root: str) -> Column:
    """A file's path below ``root``."""
    base = _place(spark, root)[1].makeQualified(_place(spark, root)[0]).toUri().getPath().rstrip("/")
    path = F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 20)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents from JSON lines; malformed lines and blank or repeated ids raise."""
    rows = read_json_lines(spark, path, schema)
    bad = rows.groupBy("id").count().filter("id IS NULL OR trim(id) = '' OR count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"blank or repeated ids, among them {[r['id'] for r in bad]}")
    return rows


def _same(rows: DataFrame, model: str | None, dimension: int | None) -> None:
    """Raise unless all rows are of one model and dimension, of those asked for, and of vectors that long."""
    wrong = F.count_if(~F.coalesce(F.size("embedding") == F.col("dimension"), F.lit(False)))
    nulls = F.count_if(F.col("model").isNull() | F.col("dimension").isNull())
    r = rows.agg(F.min("model").alias("m0"), F.max("model").alias("m1"), F.min("dimension").alias("d0"), F.max("dimension").alias("d1"), wrong.alias("wrong"), nulls.alias("nulls")).first()
    if r["nulls"] or r["m0"] != r["m1"] or r["d0"] != r["d1"]:
        raise ValueError(f"vectors of more than one model or dimension: {r['m0']} to {r['m1']}, {r['d0']} to {r['d1']}, {r['nulls']} without")
    if r["m0"] is not None and (model not in {None, r["m0"]} or dimension not in {None, r["d0"]}):
        raise ValueError(f"vectors of {r['m0']} with {r['d0']} numbers, not of {model} with {dimension}")
    if r["wrong"]:
        raise ValueError(f"{r['wrong']} vectors of another length than {r['d0']}")


def read_vectors(spark: SparkSession, path: str, model: str | None = None, dimension: int | None = None) -> DataFrame:
    """Embeddings (id, model, dimension, embedding) from Parquet, at unit length; a zero vector stays as it is.

    Raises on mixed or missing models and dimensions, on others than those asked for, and on vectors of another length.
    """
    rows = spark.read.parquet(path)
    _same(rows, model, dimension)
    return rows.withColumn("embedding", vectors.normalized(F.col("embedding").cast("array<double>")))


def read_partial_vectors(spark: SparkSession, path: str, model: str, dimension: int) -> DataFrame:
    """(id, model, dimension, text_sha256, embedding) that an interrupted run left as JSON lines.

    Cut-off lines and those without an id are dropped; rows of another model or dimension raise.
    """
    schema = "id string, model string, dimension int, text_sha256 string, embedding array<double>, broken string"
    rows = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
    rows = rows.filter("broken IS NULL AND id IS NOT NULL").drop("broken")
    _same(rows, model, dimension)
    return rows


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small report as indented JSON with a line feed at the end; what was there is replaced."""
    at, files = _place(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()


def vectors_manifest(embedded: DataFrame, documents: DataFrame) -> dict:
    """What an artifact (id, model, dimension, text_sha256) holds of the documents (id, kind, text).

    Total and counts by kind, how many documents lack a vector of their present text, and a hash of all (id, text) that
    does not depend on their order. Kinds are types of the graph: one row each reaches the driver.
    """
    docs = documents.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = embedded.select("id", "text_sha256").distinct().withColumn("has", F.lit(1))
    hashed = F.xxhash64("id", "text_sha256")
    rows = docs.join(known, ["id", "text_sha256"], "left").groupBy("kind").agg(F.count("has").alias("has"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id, text_sha256))").alias("x"), F.sum(hashed.cast("decimal(38,0)")).alias("s"))
    counts = sorted(rows.collect(), key=lambda r: (r["kind"] is None, r["kind"] or ""))
    first = embedded.agg(F.min("model").alias("model"), F.min("dimension").alias("dimension")).first()
    xor = 0
    for r in counts:
        xor ^= r["x"] & 0xFFFFFFFFFFFFFFFF
    missing = sum(r["n"] - r["has"] for r in counts)
    return {
        "model": first["model"],
        "dimension": first["dimension"],
        "total": sum(r["has"] for r in counts),
        "by_kind": {r["kind"] or "": r["has"] for r in counts},
        "source_hash": f"{xor:016x}{sum(int(r['s']) for r in counts) & 0xFFFFFFFFFFFFFFFF:016x}",
        "warnings": [f"{missing} documents without a vector of their present text"] * (missing > 0),
    }
