"""Terms counted where their texts are: a task counts some megabytes of tokens at a time, and no row of a single term is shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Bytes of tokens that are counted together, ROW more for each row, and rows that are handed back to Spark at a time, at most (a longer text comes alone).
CHUNK, ROW, SLICE = 1 << 23, 1 << 9, 1 << 16
#: Rows and bytes that Python gets at a time, at most.
BATCH, BATCH_BYTES = 500, 1 << 22
#: Folders the postings are dealt to by their terms' words; what stands between texts that are counted as one.
BUCKETS, SPREAD, SEPARATOR = 64, 31, "|"
NAMES = ("bucket", "terms", "docs", "rows", "tfs", "ids", "kinds", "lens")


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with bounded batches. Spark reads the bounds when the plan runs, so they stay set for the session; smaller ones are kept."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(f"spark.sql.execution.arrow.{name}", None)).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(function, schema)


def joined(column: Column) -> Column:
    """The tokens of a text joined by blanks; null where there is none."""
    return F.nullif(F.array_join(text.tokenize(column), " "), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The batches put together until the columns ``names`` hold CHUNK bytes."""
    held, size = [], 0
    for batch in batches:
        more = sum(batch.column(n).nbytes for n in names) + ROW * batch.num_rows
        if held and size + more > CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(batch)
        size += more
    if size or held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal sorted keys start, and how long they are."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


@dataclass
class Counts:
    """Unigrams and bigrams of some texts: the distinct ``terms`` and the folder of each; ``term``, ``row`` and ``tf`` of every term in a
    text, by term and row, the first two as positions."""

    terms: pa.Array
    bucket: np.ndarray
    term: np.ndarray
    row: np.ndarray
    tf: np.ndarray


def count(tokens: pa.Array) -> Counts:
    """Count texts (``joined``) row by row. Words are in order, so terms are too, unigrams first."""
    lists = pc.split_pattern(tokens, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded, n = lists.flatten().dictionary_encode(), max(1, len(tokens))
    order = pc.array_sort_indices(coded.dictionary)
    words, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code, v = place[coded.indices.to_numpy()], len(words)
    if (v + v * v) * n >= 1 << 63:
        raise ValueError("too many words at once")
    row = np.repeat(np.arange(len(tokens)), sizes)
    word = code != words.index(SEPARATOR).as_py()
    pair = np.flatnonzero((row[1:] == row[:-1]) & word[1:] & word[:-1])
    key = np.concatenate((code[word] * n + row[word], (v + code[pair] * v + code[pair + 1]) * n + row[pair]))
    key.sort()
    start, tf = grouped(key)
    term, row = np.divmod(key[start], n)
    first, runs = grouped(term)
    distinct = term[first]
    single, (one, two) = distinct[distinct < v], np.divmod(distinct[distinct >= v] - v, max(1, v))
    both = pc.binary_join_element_wise(words.take(pa.array(one)), words.take(pa.array(two)), " ")
    marks = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.int64)
    bucket = np.concatenate((marks[single] * SPREAD, marks[one] * SPREAD + marks[two])) % BUCKETS
    return Counts(pa.concat_arrays([words.take(pa.array(single)), both]), bucket.astype(np.uint8), np.repeat(np.arange(len(distinct)), runs), row, tf)


def bucket(term: Column) -> Column:
    """The folder of a term, from its words."""
    second = F.when(term.contains(" "), F.crc32(F.substring_index(term, " ", -1))).otherwise(F.lit(0))
    return F.pmod(F.crc32(F.substring_index(term, " ", 1)) * SPREAD + second, F.lit(BUCKETS)).cast("int")


def slices(schema: pa.Schema, columns: list, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)
    yield from table.to_batches(max_chunksize=most)


def counted(docs: DataFrame, merge: bool) -> DataFrame:
    """(id, kind, len, tokens) of (id, kind, text), the length at least 1; with ``merge``, rows that agree in the first three are one text,
    no bigram crossing from one to the next."""
    split = docs.select("id", F.col("kind").cast("string").alias("kind"), text.tokenize(F.col("text")).alias("t"))
    rows = split.select("id", "kind", F.greatest(F.lit(1), F.size("t")).alias("len"), F.nullif(F.array_join("t", " "), F.lit("")).alias("tokens"))
    if merge:
        rows = rows.groupBy("id", "kind", "len").agg(F.nullif(F.array_join(F.collect_list("tokens"), f" {SEPARATOR} "), F.lit("")).alias("tokens"))
    return rows


def blocks(docs: DataFrame, merge: bool) -> DataFrame:
    """Postings of (id, kind, text) in blocks: a row for each chunk of texts and folder of terms.

    ``terms`` are a block's terms; ``docs`` how many texts hold each; ``rows`` and ``tfs``, end to end for the terms, which they are, as
    positions in ``ids``, ``kinds`` and ``lens``, and how often. In folder -1 ``tfs`` has the sum of squares of each text's counts.
    """
    kind_of_id = docs.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, ("tokens",)):
            found, ids, kinds, lens = count(whole(table, "tokens")), whole(table, "id"), whole(table, "kind"), whole(table, "len")
            n, at = len(ids), found.bucket[found.term]
            order, terms = np.argsort(at, kind="stable"), np.argsort(found.bucket, kind="stable")
            sizes = np.bincount(found.term, minlength=len(terms)).astype(np.int32)
            squares = np.bincount(found.row, found.tf.astype(np.float64) ** 2, n).astype(np.int64)
            full = np.flatnonzero(np.bincount(at, minlength=BUCKETS))
            ends = lambda values: np.append(0, np.cumsum(np.bincount(values, minlength=BUCKETS)[full])).astype(np.int32)
            every, spans = pa.array(np.tile(np.arange(n), len(full) + 1)), np.arange(len(full) + 2, dtype=np.int32) * n
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), values)
            first = lambda offsets, size: np.append(0, offsets + size).astype(np.int32)  # noqa: E731  the block of folder -1 comes first
            columns = [
                pa.array(np.append(-1, full).astype(np.int32)),
                lists(first(ends(found.bucket), 0), found.terms.take(pa.array(terms))),
                lists(first(ends(found.bucket), 0), pa.array(sizes[terms])),
                lists(first(ends(at), 0), pa.array(found.row[order].astype(np.int32))),
                lists(first(ends(at), n), pa.array(np.concatenate((squares, found.tf[order])))),
                *[lists(spans, c.take(every)) for c in (ids, kinds, lens)],
            ]
            yield from slices(pa.schema(list(zip(NAMES, (c.type for c in columns), strict=True))), columns, 8)

    return map_arrow(counted(docs, merge), each, f"bucket int, terms array<string>, docs array<int>, rows array<int>, tfs array<long>, ids array<{kind_of_id}>, kinds array<string>, lens array<int>")


def expand(found: DataFrame, kind_of_id: str, asked: list[str] | None = None) -> DataFrame:
    """(bucket, term, id, kind, len, tf) of blocks; with ``asked``, of those terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                at, terms, docs, rows, tfs, ids, kinds, lens = (c[i].values if pa.types.is_list(c.type) else c[i].as_py() for c in batch.columns)
                docs = docs.to_numpy()
                kept = np.arange(len(docs)) if wanted is None else np.flatnonzero(pc.is_in(terms, wanted).to_numpy(zero_copy_only=False))
                start = (np.cumsum(docs) - docs)[kept]
                many = docs[kept].astype(np.int64)
                spot = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
                row = rows.take(pa.array(spot))
                columns = [np.full(len(spot), at, np.int32), terms.take(pa.array(np.repeat(kept, many))), ids.take(row), kinds.take(row), lens.take(row), tfs.take(pa.array(spot))]
                yield from slices(pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("id", ids.type), ("kind", pa.string()), ("len", pa.int32()), ("tf", pa.int64())]), columns)

    return map_arrow(found.select(*NAMES), each, f"bucket int, term string, id {kind_of_id}, kind string, len int, tf long")


def totals(docs: DataFrame, merge: bool, bigrams: bool = False) -> DataFrame:
    """(kind, term, n, docs) of (id, kind, text): how often each kind's texts hold a term and how many do; with ``bigrams``, of those alone
    and with a null kind. A chunk's terms are added up before they are shuffled, once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
        for table in chunks(batches, ("tokens",)):
            found = count(whole(table, "tokens"))
            coded = whole(table, "kind").dictionary_encode(null_encoding="encode")
            k = max(1, len(coded.dictionary))
            key, tf = found.term * k + coded.indices.to_numpy()[found.row], found.tf
            if bigrams:
                kept = pc.match_substring(found.terms, " ").to_numpy(zero_copy_only=False)[found.term]
                key, tf = found.term[kept] * k, tf[kept]
            order = np.argsort(key, kind="stable")
            start, runs = grouped(key[order])
            sums = key[order][start]
            n = np.add.reduceat(tf[order], start) if len(start) else np.zeros(0, np.int64)
            kinds = pa.nulls(len(sums), pa.string()) if bigrams else coded.dictionary.take(pa.array(sums % k))
            yield from slices(schema, [kinds, found.terms.take(pa.array(sums // k)), n, runs])

    found = map_arrow(counted(docs, merge).select("kind", "tokens"), each, "kind string, term string, n long, docs long").repartition("kind", "term")
    return found.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def hashed(docs: DataFrame, dim: int, code: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, place, v, norm) of (id, text): each term adds its sign to a place, both from ``code``; places of 0 are left out, and norm is
    the row's. Ids that repeat are not merged."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, ("tokens",)):
            found, ids = count(whole(table, "tokens")), whole(table, "id")
            place, sign = code(found.terms.to_pylist(), dim)
            grid = np.bincount(found.row * dim + place[found.term], sign[found.term] * found.tf, len(ids) * dim).astype(np.int64).reshape(-1, dim)
            norm = np.sqrt((grid * grid).sum(axis=1).astype(np.float64))
            at, spot = np.nonzero(grid)
            schema = pa.schema([("id", ids.type), ("place", pa.int64()), ("v", pa.int64()), ("norm", pa.float64())])
            yield from slices(schema, [ids.take(pa.array(at)), spot.astype(np.int64), grid[at, spot], norm[at]])

    return map_arrow(docs.select("id", joined(F.col("text")).alias("tokens")), each, f"id {fields['id']}, place long, v long, norm double")


def cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of texts (a, b, x, y), by the counts of their terms; 0 where either has none."""
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, ("x", "y")):
            m = table.num_rows
            found = count(pa.concat_arrays([whole(table, "x"), whole(table, "y")]))
            term, row, tf = found.term, found.row, found.tf
            norm = np.sqrt(np.bincount(row, tf.astype(np.float64) ** 2, 2 * m))
            left, key = row < m, term * m + row % max(1, m)
            shared, i, j = np.intersect1d(key[left], key[~left], assume_unique=True, return_indices=True)
            dot = np.bincount(shared % max(1, m), (tf[left][i] * tf[~left][j]).astype(np.float64), m)
            cosine = np.divide(np.divide(dot, norm[:m], out=np.zeros(m), where=dot > 0), norm[m:], out=np.zeros(m), where=dot > 0)
            schema = pa.schema([("a", table.schema.field("a").type), ("b", table.schema.field("b").type), ("cosine", pa.float64())])
            yield from slices(schema, [whole(table, "a"), whole(table, "b"), cosine])

    return map_arrow(pairs.select("a", "b", "x", "y"), each, f"a {fields['a']}, b {fields['b']}, cosine double")
