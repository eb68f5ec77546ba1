"""The saved index of a corpus: postings by term and one row a document, built once and read by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..storage import save, scratch
from . import counts
from .counts import bucket

_BUILT: dict[tuple, object] = {}


def once(read: DataFrame | list[DataFrame], name: str, make):
    """``make()`` for the files that ``read`` reads as they are now: kept for the session, made anew when a file changes."""
    frames = read if isinstance(read, list) else [read]
    spark = frames[0].sparkSession
    known = []
    for file in sorted(f for df in frames for f in df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        known.append((file, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(known))
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def forget(name: str) -> None:
    """Let what ``once`` keeps under this name be made anew."""
    for key in [k for k in _BUILT if k[1] == name]:
        del _BUILT[key]


def postings(docs: DataFrame) -> DataFrame:
    """(id, kind, len, term, tf) from (id, kind, text); the length counts unigrams, at least 1."""
    tokens = docs.select("id", "kind", text.tokenize(F.col("text")).alias("tokens"))
    rows = tokens.select("id", "kind", F.greatest(F.lit(1), F.size("tokens")).alias("len"), F.explode(F.concat("tokens", text.bigrams(F.col("tokens")))).alias("term"))
    return rows.groupBy("id", "kind", "len", "term").agg(F.count("*").alias("tf"))


@dataclass
class Index:
    """``blocks`` of postings (``counts.blocks``) in folders by term, ``documents`` (id, kind, len, norm and what else came with them but
    the text), their number and average length."""

    blocks: DataFrame
    documents: DataFrame
    n: int
    average: float

    def expand(self, found: DataFrame, asked: list[str] | None = None) -> DataFrame:
        return counts.expand(found, self.documents.schema["id"].dataType.simpleString(), asked)

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, id, kind, len, tf)"""
        return self.expand(self.blocks)


def repeats(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return once(docs, "repeats", lambda: not docs.groupBy("id").count().filter("count > 1").isEmpty())


def build(docs: DataFrame) -> Index:
    """Index (id, kind, text, ...): texts are tokenised once and their postings written, in blocks, by the task that reads them. Nothing
    is shuffled but what each document adds up to, and the texts of ids that repeat; a frequent term is spread over the tasks' files."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    rows = counts.blocks(docs, repeats(docs))
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(counts.BUCKETS + 2))  # one more than the folders, else a task sorts its blocks by folder
    try:
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(writers, before)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    written = spark.read.schema(fields).parquet(path)
    each = written.filter("bucket < 0").select(F.inline(F.arrays_zip("ids", "lens", "tfs"))).toDF("id", "len", "tf")
    sizes = each.groupBy("id").agg(F.first("len").alias("len"), F.sqrt(F.sum("tf")).alias("norm"))
    rest = docs.drop("text").join(sizes, "id", "left")
    documents = save(rest.withColumn("len", F.coalesce("len", F.lit(1))).withColumn("norm", F.coalesce("norm", F.lit(0.0))))
    n, average = documents.agg(F.count("*"), F.avg("len")).first()
    return Index(written.filter("bucket >= 0"), documents, n, average or 1.0)


def index_of(docs: DataFrame) -> Index:
    """The index of (id, kind, text), built when the files behind it are first asked for."""
    return once(docs, "index", lambda: build(docs))


def units_of(embeddings: DataFrame) -> DataFrame:
    """(id, kind, v): vectors (id, kind, embedding) of unit length, made when the files behind them are first asked for."""
    return once(embeddings, "units", lambda: save(embeddings.select("id", "kind", vectors.normalized(F.col("embedding")).alias("v"))))


def asked_postings(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the terms of ``asked`` (query, term, ...), joined to it and to ``df``.

    Searches are short texts: their terms go to the driver and come back as literals, so that only their folders are read.
    """
    rows = asked.withColumn("bucket", bucket(F.col("term"))).collect()
    places, terms = sorted({r["bucket"] for r in rows}), sorted({r["term"] for r in rows})
    found = index.expand(index.blocks.filter(F.col("bucket").isin(places)), terms)
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}
    names = [c for c in asked.columns if c != "term"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    local = asked.sparkSession.createDataFrame([(*(r[c] for c in asked.columns), df[r["term"]]) for r in rows if r["term"] in df], f"{types}, df long")
    return found.drop("bucket").join(F.broadcast(local), "term").select(*names, "term", "df", "id", "kind", "len", "tf")
