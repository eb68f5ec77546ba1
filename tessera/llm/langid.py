"""Language identification by Bayesian fusion of text, declared language, address suffix and host history."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, map_arrow, row_hashes, save, unused

#: Labelled rows per language that the text model is fitted on at most, and least for a class of its own; buckets of byte trigrams.
SAMPLE, FEWEST, BUCKETS = 3_000, 5, 1 << 15
#: Correlation of the trigrams of one text, pseudo-rows of the parent level, least confidence, least vote of a text.
RHO, KAPPA, ACCEPT, VOTE = 1 / 64, 20.0, 0.5, 1e-3
#: The class of all declared languages with fewer rows than FEWEST, and that of a table that declares none.
OTHER, UNKNOWN = "other", "und"
#: Names under which country domains sell addresses.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
_MIX = np.uint32(2654435761)


@dataclass
class Model:
    """Languages and, for the texts of either half, the log-probability of each trigram bucket in each language."""

    languages: list[str]
    tables: list[np.ndarray]


def _bytes(text: str) -> np.ndarray:
    """Bytes of the lower-cased text, at least three; none without letters."""
    if not any(map(str.isalpha, text)):
        return np.zeros(0, np.uint8)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    return np.concatenate([data, np.full(3 - len(data), 32, np.uint8)]) if len(data) < 3 else data


def _trigrams(data: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams, ``chunk`` at a time, so that a long text needs no more memory than a short one."""
    for at in range(0, len(data) - 2, chunk):
        x = data[at : at + chunk + 2].astype(np.uint32)
        mixed = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * _MIX
        yield (mixed >> np.uint32(17)).astype(np.int32)


def half(text: Column) -> Column:
    """0 or 1: the half of the texts that a text is in; equal texts are in the same one."""
    return F.shiftright(F.xxhash64(text), 40).bitwiseAND(F.lit(1)).cast("int")


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (text, declared): every language that FEWEST rows declare, the others together as OTHER.

    Up to about ``sample`` rows of each class are taken by the hash of their text, so equal tables give equal models. Counts
    are kept for either half of the texts and a text is scored by the other half's, so that neither it nor a copy of it
    confirms itself; a class without texts in a half borrows the other's. Counts are summed per task and class: twice BUCKETS numbers
    for each declared code reach the driver, and codes have two or three letters.
    """
    rows = rows.filter("declared is not null and text is not null")
    counted = {r["declared"]: r["n"] for r in rows.groupBy("declared").agg(F.count("*").alias("n")).collect()}
    known = sorted(c for c, n in counted.items() if n >= FEWEST and c != OTHER)
    rare = sum(n for c, n in counted.items() if c not in known)
    languages = known + [OTHER] * (rare > 0)
    if not languages:
        return Model([UNKNOWN], [np.zeros((BUCKETS, 1), np.float32)] * 2)
    number = {c: i for i, c in enumerate(languages)}
    facts = [(c, number.get(c, number.get(OTHER)), min(1.0, sample / (n if c in number else rare))) for c, n in counted.items()]
    facts = rows.sparkSession.createDataFrame(facts, "declared string, at int, share double")  # a row for each code
    chosen = rows.join(F.broadcast(facts), "declared").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    width = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for text, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for ids in _trigrams(_bytes(text), 1 << 16):
                    counts.setdefault(cell, np.zeros(BUCKETS, np.int64))
                    counts[cell] += np.bincount(ids, minlength=BUCKETS)
        for cell, found in sorted(counts.items()):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell, np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["cell", "bucket", "n"])

    cells = chosen.select("text", (half(F.col("text")) * width + F.col("at")).cast("int").alias("cell"))
    got = map_arrow(cells, run, "cell int, bucket int, n long").groupBy("cell", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2 * width, BUCKETS))
    counts[got["cell"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(2, width, BUCKETS)
    tables = []
    for mine in (0, 1):
        other = np.where(counts[1 - mine].sum(1, keepdims=True) > 0, counts[1 - mine], counts[mine]) + 0.5
        tables.append(np.log(other / other.sum(1, keepdims=True)).T.astype(np.float32).copy())
    return Model(languages, tables)


def tempered(total: np.ndarray, n: int) -> np.ndarray:
    """Log-likelihood of ``n`` trigrams as if they were n / (1 + (n - 1) RHO) independent ones."""
    return total / (1 + (n - 1) * RHO) if n else total


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """Every column but text, with ``trigrams`` and ``ll``, the tempered log-likelihood of the whole text in each language."""
    names = [c for c in rows.columns if c != "text"]
    width = len(model.languages)
    chunk = max(1 << 10, (1 << 19) // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            counts, lls = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, width))
            for i, (text, fold) in enumerate(zip(b.column(0), b.column(1).to_pylist(), strict=True)):
                data = _bytes(text.as_py() or "")
                for ids in _trigrams(data, chunk):
                    lls[i] += model.tables[fold].take(ids, axis=0).sum(0, dtype=np.float64)
                counts[i] = max(0, len(data) - 2)
                lls[i] = tempered(lls[i], counts[i])
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, lls.size + 1, width), pa.int32()), pa.array(lls.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(counts), ll], names=[*names, "trigrams", "ll"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    wide = rows.select("text", F.coalesce(half(F.col("text")), F.lit(0)).alias("half"), *names)
    return map_arrow(wide, run, ", ".join([*fields, "trigrams long", "ll array<double>"]))


def _exp(values: str) -> Column:
    """Exponentials of an array, the largest being 1."""
    return F.transform(values, lambda x: F.exp(x - F.array_max(values)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _total(n: int, name: str) -> Column:
    """Sum of arrays of ``n`` numbers, place by place."""
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """Posterior from ``scored``: (key columns, declared, host, domain, suffix, trigrams, ll), a saved table without texts.

    log P(language | all) = text + log P(language | host) + evidence of the declared language + evidence of the suffix.
    Grouped sums of the texts' own posteriors (votes under VOTE count 0) give the share of each language among the rows of
    a host, of its domain, of a suffix and of a declared language. A host's share is smoothed towards its domain's and that
    towards the whole's with KAPPA pseudo-rows; declared language and suffix count as their smoothed share over the whole's,
    the suffix the less, the more rows the host has itself. A row's own posterior is left out of all sums, so a text does
    not confirm itself. Null evidence counts nothing. Hot hosts are joined as in ``attach``.

    Adds language, confidence and accepted: the text has a trigram and its best language at least ACCEPT. Equal posteriors
    go to the language first in code point order.
    """
    n = len(model.languages)
    rows = scored.withColumn("__e", _exp("ll")).withColumn("__p", F.transform("__e", lambda x: x / _sum(F.col("__e")))).drop("__e")
    votes = F.transform("__p", lambda x: F.when((F.col("trigrams") > 0) & (x >= VOTE), x).otherwise(F.lit(0.0)))
    rows = save(rows.withColumn("__p", votes).withColumn("__w", (F.col("trigrams") > 0).cast("double")))
    sums = [_total(n, "__p").alias("s"), F.sum("__w").alias("w"), F.count("*").alias("n")]
    hosts = save(rows.filter("host is not null").groupBy("host", "domain", "suffix").agg(*sums))
    whole = rows.agg(*sums).first()
    g = [((whole["s"][i] or 0) + 1) / ((whole["w"] or 0) + n) for i in range(n)]

    known = hosts.select(F.xxhash64("host", "domain", "suffix").alias("place"), "domain", "suffix", F.col("s").alias("__host_s"), F.col("w").alias("__host_w"), F.col("n").alias("__rows"))
    for level in ("domain", "suffix"):
        names = [f"__{level}_s", f"__{level}_w"]
        if hosts.filter(f"{level} is not null").isEmpty():  # no evidence of this kind anywhere
            known = known.withColumns({names[0]: F.lit(None).cast("array<double>"), names[1]: F.lit(None).cast("double")})
            continue
        facts = hosts.filter(f"{level} is not null").groupBy(F.col(level).alias("__key")).agg(_total(n, "s").alias(names[0]), F.sum("w").alias(names[1]), F.count("*").alias("n"))  # here a key's rows are its hosts
        known = attach(known.withColumn("__key", F.col(level)), save(facts), "__key", [F.col("place")]).drop("__key", "n")
    known = save(known.drop("domain", "suffix").withColumnRenamed("__rows", "n"))
    rows = rows.withColumn("place", F.when(F.col("host").isNotNull(), F.xxhash64("host", "domain", "suffix")))
    spread = [F.col("trigrams"), F.col("__p"), *[F.col(c) for c in scored.columns if c not in {"ll", "trigrams"}]]
    rows = attach(rows, known, "place", spread).drop("place", "n")
    other = F.when(F.col("declared").isNotNull(), F.lit(OTHER if OTHER in model.languages else "?"))
    rows = rows.withColumn("__said", F.when(F.col("declared").isin(model.languages), F.col("declared")).otherwise(other))
    facts = rows.filter("__said is not null").groupBy(F.col("__said").alias("__key")).agg(_total(n, "__p").alias("__said_s"), F.sum("__w").alias("__said_w"))
    rows = rows.join(F.broadcast(facts), F.col("__said") == F.col("__key"), "left")  # a row for each class of the model, and one

    shares = F.array(*[F.lit(float(x)) for x in g])

    def share(level: str, i: Column, parent: Column) -> Column:
        votes = F.greatest(F.lit(0.0), F.coalesce(F.get(f"__{level}_s", i) - F.get("__p", i), F.lit(0.0)))
        return (votes + KAPPA * parent) / (others(level) + KAPPA)

    def others(level: str) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"__{level}_w") - F.col("__w"), F.lit(0.0)))

    def term(i: Column) -> Column:
        whole = F.get(shares, i)
        host = share("host", i, share("domain", i, whole))
        declared = F.log(share("said", i, whole) / whole)
        suffix = F.log(share("suffix", i, whole) / whole) * KAPPA / (others("host") + KAPPA)
        return F.get("ll", i) + F.log(host) + declared + suffix

    keys = [c for c in scored.columns if c != "ll"]
    # Written here, for a filter on the result would otherwise copy these terms into each of its own.
    rows = save(rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), term).alias("__f")))
    best = F.array_position("__f", F.array_max("__f")).cast("int")
    language = F.element_at(F.array(*[F.lit(x) for x in model.languages]), best)
    confidence = 1 / _sum(_exp("__f"))
    accepted = (F.col("trigrams") > 0) & (confidence >= ACCEPT)
    return rows.select(*keys, language.alias("language"), confidence.alias("confidence"), accepted.alias("accepted"))


def declared_code(name: Column) -> Column:
    """'en-US', 'EN' and 'en' are 'en'; what does not start with two or three letters is null."""
    code = F.regexp_extract(F.lower(F.trim(name)), r"^([a-z]{2,3})(?![a-z])", 1)
    return F.when(code != "", code)


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, the domain it belongs to and its last label.

    The domain is the last two labels, or three under a country's SECOND_LEVEL name; it is null where that is the whole
    host. Hosts that are numbers have neither domain nor suffix; null and relative addresses have nothing.
    """
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("."))
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1)
    short = "|".join(SECOND_LEVEL)
    domain = F.regexp_extract(host, rf"(?:^|\.)([^.]+\.(?:{short})\.[a-z][a-z])$", 1)
    domain = F.when(domain != "", domain).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    return host, F.when((domain != "") & (suffix != "") & (domain != host), domain), F.when(suffix != "", suffix)


def markup(html: Column) -> tuple[Column, Column]:
    """Visible text, without scripts, styles, comments and tags, and the language that the html tag declares."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return text, declared_code(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def identify(rows: DataFrame) -> DataFrame:
    """Language of each row of (key columns, text, declared, host, domain, suffix): see ``fuse``.

    Null and empty texts, and those without letters, are never accepted; their language comes from the other evidence.
    Repeated rows get equal results. An empty table gives no rows. With no declared language anywhere there is nothing
    to learn from: the language is UNKNOWN. Key columns may have any name but those given here and those that start with '__'.
    """
    model = train(rows)
    return fuse(save(likelihoods(rows, model)), model)


def of_documents(docs: DataFrame) -> list[Column]:
    """Documents as evidence: ``lang`` is the declared language and ``source`` the host, which has no address."""
    none = F.lit(None).cast("string")
    return [F.col("text"), declared_code(F.col("lang")).alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix")]


def of_pages(pages: DataFrame) -> list[Column]:
    """Web pages as evidence: their visible text, the language their markup declares, and their address."""
    text, declared = markup(F.col("html"))
    host, domain, suffix = address(F.col("url"))
    return [text.alias("text"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix")]


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page with its language, from its text, markup, address suffix and host.

    Null pages and addresses, pages without text, repeated pages and an empty table: as in ``identify``.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return identify(pages.select("page_id", *of_pages(pages))).select("page_id", "declared", "host", "domain", "suffix", "language", "confidence", "accepted")


def documents_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on documents, which have no address: ``source`` is the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *of_documents(docs)))
    return found.select("doc_id", "declared", "language", "confidence", "accepted")


def accepted(docs: DataFrame, bound: int = 100_000) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns, whatever those are called.

    Decisions carry two hashes of the row's columns; equal rows have equal decisions. The rejected hashes are broadcast if
    a count shows that there are at most ``bound``, else joined by a shuffle.
    """
    h1, h2 = row_hashes(docs)
    wide = docs.select(h1.alias("h1"), h2.alias("h2"), *of_documents(docs))
    gone = save(identify(wide).filter(~F.col("accepted")).select("h1", "h2").distinct())
    a, b = unused(docs.columns, "h1"), unused(docs.columns, "h2")
    if gone.count() <= bound:
        gone = F.broadcast(gone)
    return docs.withColumns({a: h1, b: h2}).join(gone.toDF(a, b), [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
