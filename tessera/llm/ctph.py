"""Context-triggered piecewise hashing: a rolling hash cuts chunks, chunk hashes make a signature, signatures are
compared by edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, map_arrow, partitions, text_or_empty

#: Bytes the rolling hash sees, smallest block size, most and least wanted characters of a signature.
WINDOW, LEAST_BLOCK, LONGEST, SHORTEST = 7, 3, 64, 32
#: Bytes of the input, as stored, that a range of documents should hold, and ranges at most, for the driver knows the first row of
#: each; a task gets about eight ranges and streams them, so longer ranges cost it time and no memory.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 100_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last WINDOW bytes at each byte: their weighted sum plus the XOR of their shifts."""
    x = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    sums, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for i in range(WINDOW):
        part = x[WINDOW - 1 - i : WINDOW - 1 - i + n]
        sums += part * np.uint32(WINDOW + 1 - i)
        mixed ^= part << np.uint32(5 * i)
    sums += mixed
    return sums


def fingerprint(data: bytes) -> str:
    """'block:signature:signature at twice the block'. Each character is a chunk's hash; the last chunk takes the rest.

    The block is the smallest LEAST_BLOCK * 2^k that would give at most LONGEST characters, halved while the signature is
    shorter than SHORTEST. The empty text has empty signatures.
    """
    block = LEAST_BLOCK
    while block * LONGEST < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    hashes = rolling(np.frombuffer(data, np.uint8))
    while True:
        cuts = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if len(cuts) + 1 >= SHORTEST or block == LEAST_BLOCK:
            break
        block //= 2
    twice = cuts[hashes[cuts] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, cuts, LONGEST)}:{_signature(data, twice, LONGEST // 2)}"


def _signature(data: bytes, cuts: np.ndarray, longest: int) -> str:
    ends = (cuts[: longest - 1] + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return "".join([ALPHABET[xxhash.xxh32_intdigest(data[i:j]) & 63] for i, j in zip([0, *ends], ends, strict=False)])


def distance(a: str, b: str) -> int:
    """Levenshtein distance, all cells of a row at once in the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, d = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        hp, hm = minus | ~(eq | plus), plus & eq
        if hp & top:
            d += 1
        if hm & top:
            d -= 1
        hp, hm = hp << 1 | 1, hm << 1
        plus, minus = (hm | ~(x | hp)) & full, hp & x & full
    return d


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(7, max(1, min(len(a), len(b)) // 3))  # as many characters in a row must be common
    if not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: signatures at the same block, which are compared if the blocks are equal or one is twice the other."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2) if min(len(x2), len(y2)) >= 7 else 0.0)
    if bx == 2 * by:
        return _alike(x1, y2)
    return _alike(x2, y1) if by == 2 * bx else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()])], names=["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text")), run, "doc_id long, fingerprint string")


def _buckets(docs: DataFrame) -> int:
    """As many ranges as keep one near BUCKET_BYTES by the size that Spark knows of the input, and four to a task at least."""
    stats = docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats()
    known = int(str(stats.sizeInBytes()))
    return max(4 * partitions(docs.sparkSession), min(-(-known // BUCKET_BYTES), docs.count() // 64, MOST_BUCKETS))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, own, doc_id, tie, text), partitioned by bucket and sorted so that a row's next document follows it.

    The order is descending doc_id, then descending hash of the text, null ids last; after the last comes the first.
    Buckets are ranges of that order, as many as the input's bytes ask for; null ids, and each id with more than one in HOT_SHARE
    rows, are ranged further by their hash. The first row of each bucket is sent to the bucket before as well (own false), so
    a text is shuffled once and nothing is sorted globally.
    """
    spark = docs.sparkSession
    n = _buckets(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    often = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") * HOT_SHARE > total)
    hot = sorted(r["doc_id"] for r in often.filter("rows > 1000").collect())  # fewer than HOT_SHARE
    cuts = ids.select(F.col("doc_id").cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n)
    splits = sorted({*cuts, *(x for h in hot for x in (float(h), float(np.nextafter(float(h), np.inf))))})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.col("doc_id").cast("double"))
    if splits:
        bounds = [float("-inf"), *splits, float("inf")]
        rows = Bucketizer(splits=bounds, inputCol="at", outputCol="range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0.0))
    part = F.shiftright("tie", 54) + 512  # 1,024 ranges of the hash
    near = [float(h) for h in hot]
    shared = F.col("at").isin(near) if near else F.lit(False)
    bucket = F.when(F.col("doc_id").isNull(), part - 1024).otherwise(F.col("range").cast("long") * 1024 + F.when(shared, part).otherwise(F.lit(0)))
    rows = rows.withColumn("bucket", bucket).drop("at", "range")
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("first")).orderBy(F.desc("bucket")).collect()  # a row for each bucket
    pairs = [(r["bucket"], r["first"]["doc_id"], r["first"]["tie"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(pairs, "head long, head_id long, head_tie long, before long")
    rows = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    to = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))))
    rows = rows.select("doc_id", "tie", "text", F.explode(to).alias("to")).select("to.bucket", "to.own", "doc_id", "tie", "text")
    order = [F.desc("bucket"), F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("tie")]
    return rows.repartition(max(partitions(spark), n // 8), "bucket").sortWithinPartitions(*order)


def edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last third replaced by the next document's start, and likenesses.

    Null texts are empty, and empty ones have empty signatures; very long texts are hashed whole. Rows that repeat an id follow
    one another, in the order of a hash of their texts; null ids come last. A table of one document has itself as its next. An empty table
    gives no rows. Other columns of docs, whatever their names, are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out = []
                for bucket, own, doc_id, _, text in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    if last is None and not own:
                        continue
                    now = (bucket, doc_id, text, fingerprint(text.encode()))
                    if last is not None and last[0] == bucket:
                        _, last_id, last_text, print_ = last
                        cut = len(last_text) // 3
                        edited = (last_text[: len(last_text) - cut] + text[:cut]).encode()
                        changed = fingerprint(edited)
                        out.append((last_id, len(last_text), hashlib.sha256(edited).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, now[3])))
                    last = now if own else None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_next(docs), run, schema)


def op8_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; nulls, repeats and empty tables as in ``edits``."""
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
