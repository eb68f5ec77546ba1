"""WARC archives with revisit resolution: headers meet by payload digest, one response per payload is kept in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, map_arrow, save, scratch

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:record:"

#: Payloads from this size on are worth a revisit record; revisits up to this number are broadcast to the bodies.
LEAST, BOUND = 1000, 1_000_000

READ = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("digest_ok", T.BooleanType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per repeated digest: ``digest``, ``refers_to`` and ``refers_uri`` (the record of largest id) and ``n``, its records.

    ``headers`` has id, url, digest and length. Payloads under ``least`` bytes are left out. Counts and maxima are
    combined before the shuffle, so a digest with a third of all records costs its group one row per task.
    """
    by = headers.filter(F.col("length") >= least).groupBy("digest")
    found = by.agg(F.max(F.struct("id", "url")).alias("last"), F.count("*").alias("n")).filter("n > 1")
    return found.select("digest", F.col("last.id").alias("refers_to"), F.col("last.url").alias("refers_uri"), "n")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _emit(records: DataFrame, path: str, date: str) -> None:
    """Write (record_id, url, digest, length, payload, refers_to, refers_uri), whose payload is null for revisits, as WARC files.

    A record ends with two line ends, which is the separator that Spark's text writer puts after each row: files go through
    its commit protocol to any store Spark can write, and a lost executor costs its tasks only.
    """
    revisit = F.col("payload").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "\r", "%0D"), "\n", "%0A")
    target = F.concat(_line("WARC-Refers-To", F.col("refers_to")), F.coalesce(_line("WARC-Refers-To-Target-URI", tidy("refers_uri")), F.lit("")), _line("WARC-Refers-To-Date", F.lit(date)))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", tidy("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(F.coalesce(target, F.lit("")), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    record = F.concat(F.encode(head, "UTF-8"), F.coalesce("payload", F.lit(b""))).cast("string")
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _without(bodies: DataFrame, revisits: DataFrame) -> DataFrame:
    """The rows of ``bodies`` that are not among the saved ``revisits``, by id and digest; bodies stay where they are if a count
    shows that BOUND keys at most must be broadcast."""
    keys = save(revisits.select("id", "digest").distinct())
    keys = (F.broadcast(keys) if keys.count() <= BOUND else keys).toDF("gone_id", "gone_digest")
    return bodies.join(keys, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")


def write(records: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (id long, url string, payload binary) as gzipped WARC files with fresh headers below ``path``.

    Of records with equal payloads of ``least`` bytes or more, those with the largest id are responses and the
    others revisit them without a payload; records with the same id are the same page, so all of them are responses.
    The null id is smaller than any other. Smaller payloads, null ones (empty) included, are all responses. A null
    URL gives no Target-URI; control characters in URLs are percent-encoded. Other columns are not written. An empty table gives
    files without records. Only headers are shuffled, by digest: revisits are written from their headers, and bodies meet the keys of
    those that go.
    """
    records = records.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    records = records.withColumn("length", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    headers = save(records.drop("payload"))
    repeated = save(resolve(headers, least))
    keyed = headers.withColumn("key", F.when(F.col("length") >= least, F.col("digest")))
    met = attach(keyed, repeated.withColumnRenamed("digest", "key"), "key", [F.col("id"), F.col("url")])
    revisits = save(met.filter(F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))).drop("key", "n"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    none = F.lit(None).cast("string")
    full = _without(records, revisits).select(name("id").alias("record_id"), "url", "digest", "length", "payload", none.alias("refers_to"), none.alias("refers_uri"))
    rest = revisits.select(name("id").alias("record_id"), "url", "digest", "length", F.lit(None).cast("binary").alias("payload"), name("refers_to").alias("refers_to"), "refers_uri")
    _emit(full.unionByName(rest), path, date)


def originals(headers: DataFrame) -> DataFrame:
    """Records as ``read`` gives them, without payloads, each revisit joined to the response that holds its payload.

    That is the response of largest record id with the revisit's digest, whatever record its header names. Adds ``original_id`` and
    ``original_uri``, null where the archives have no such response, and for responses. Digests with a third of all records
    are spread as in ``attach``.
    """
    headers = headers.drop("payload")
    held = headers.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max(F.struct("record_id", "target_uri")).alias("last"))
    counts = headers.groupBy("payload_digest").agg(F.count("*").alias("n"))
    facts = held.join(counts, "payload_digest").select("payload_digest", F.col("last.record_id").alias("original_id"), F.col("last.target_uri").alias("original_uri"), "n")
    met = attach(headers, save(facts), "payload_digest", [F.col("record_id"), F.col("target_uri")])
    mine = lambda c: F.when(F.col("record_type") == "revisit", F.col(c)).alias(c)
    return met.select(*headers.columns, mine("original_id"), mine("original_uri"))


def merge(spark: SparkSession, paths: list[str] | str, out: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Rewrite archives, with revisits among them, as deduplicated ones with fresh headers below ``out``.

    Of responses with equal payloads of ``least`` bytes or more the one of largest record id stays, the others become revisits; each
    revisit refers to the response that holds its payload. A revisit without one in the archives keeps its header's reference.
    Record ids stay. Only headers are shuffled.
    """
    columns = [F.col("record_id").alias("id"), F.col("target_uri").alias("url"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("length")]
    bodies = read(spark, paths).filter("record_type = 'response'").select(*columns, "payload")
    headers = save(read(spark, paths, with_payload=False).select(*columns, "record_type", F.col("refers_to_id").alias("said")))
    held = headers.filter("record_type = 'response'").groupBy("digest").agg(F.max(F.struct("id", "url")).alias("last"))
    facts = held.join(headers.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    facts = facts.select("digest", F.col("last.id").alias("refers_to"), F.col("last.url").alias("refers_uri"), "n")
    met = attach(headers, save(facts), "digest", [F.col("id"), F.col("url")])
    again = (F.col("record_type") == "response") & (F.col("length") >= least) & ~F.col("id").eqNullSafe(F.col("refers_to"))
    revisits = save(met.filter(again | (F.col("record_type") == "revisit")))
    none = F.lit(None).cast("string")
    kept = _without(bodies, revisits.filter("record_type = 'response'"))
    full = kept.select(F.col("id").alias("record_id"), "url", "digest", "length", "payload", none.alias("refers_to"), none.alias("refers_uri"))
    rest = revisits.select(F.col("id").alias("record_id"), "url", "digest", "length", F.lit(None).cast("binary").alias("payload"), F.coalesce("refers_to", "said").alias("refers_to"), "refers_uri")
    _emit(full.unionByName(rest), out, date)


def _records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record, from the lines of whole files, one record in memory at a time."""
    name, head, body, have, need = None, None, [], 0, 0
    for path, line in lines:
        if path != name:
            name, head, need = path, None, 0
        if need:
            body.append(line)
            have += len(line) + 2
            if have >= need + 2:
                yield head, b"\r\n".join(body)[:need]
                head, body, have, need = None, [], 0, 0
        elif head is None:
            if line.startswith(b"WARC/1."):
                head = {}
        elif line:
            key, _, value = line.partition(b": ")
            head[key.lower()] = value
        else:
            need = int(head.get(b"content-length", b"0"))
            if not need:
                yield head, b""
                head = None


def _parse(with_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out, held = [], 0
        for head, block in _records(lines):
            http, _, payload = block.partition(b"\r\n\r\n")
            said = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
            length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
            kind = head.get(b"warc-type", b"").decode()
            own = hashlib.sha1(payload).hexdigest() if kind == "response" else said
            text = lambda k: head[k].decode("utf-8", "replace") if k in head else None  # noqa: E731, B023
            out.append((text(b"warc-record-id"), kind, text(b"warc-refers-to"), text(b"warc-target-uri"), length, own, own == said and (kind != "response" or length == len(payload)), payload if with_payload and kind == "response" else None))
            held += len(payload) if with_payload else 0
            if len(out) >= 10_000 or held >= 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read(spark: SparkSession, path: list[str] | str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with the schema READ.

    Spark's text reader opens the files in whatever store they are; a gzipped file goes whole to one task, whose lines
    are put together by Content-Length, so line ends in payloads are kept. ``digest_ok`` compares the payload's
    digest and length with the headers. A revisit's payload is null, its digest and length are the headers'.
    """
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    return map_arrow(lines, _parse(with_payload), READ)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives written from all pages give it back; nulls, repeats and empty tables as in ``write``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark) + "-warc"
    write(pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload")), path)
    number = lambda c: F.regexp_extract(c, f"<{ID}(-?[0-9]+)>", 1).try_cast("long")
    got = read(spark, path, with_payload=False)
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "digest_ok")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS digest_ok FROM q
"""
