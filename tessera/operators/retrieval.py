"""Retrieval: BM25 over unigrams and bigrams, exact vector top-k, and the two merged into candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from .index import Index, asked_postings

K1, B = 1.2, 0.75
#: Query vectors that are compared with all vectors at once.
MOST = 10_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term) from (query, text), each term once."""
    tokens = queries.select("query", text.tokenize(F.col("text")).alias("tokens"))
    return tokens.select("query", F.explode(F.array_distinct(F.concat("tokens", text.bigrams(F.col("tokens"))))).alias("term"))


def expanded(terms: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """``terms`` with, behind them in order, the phrases and words of each group of synonyms that one of its phrases is in.

    A phrase of several words is in if the sorted terms, joined by blanks, hold it.
    """
    joined = F.array_join(F.array_sort(terms), " ")
    more = F.array().cast("array<string>")
    for group in groups:
        fires = F.arrays_overlap(terms, F.array(*[F.lit(p) for p in group]))
        for phrase in group:
            if " " in phrase:
                fires |= joined.contains(phrase)
        words = sorted({*group, *(w for p in group for w in p.split())})
        more = F.concat(more, F.when(fires, F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(terms, F.array_sort(more)))


def bm25_terms(index: Index, asked: DataFrame) -> DataFrame:
    """(query, id, kind, term, idf, part): each query term's share of a document's score; idf and average length are the whole corpus's.

    Only the rows of the terms asked for are read from the index.
    """
    rows = asked_postings(index, asked.select("query", "term"))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(index.average))))
    return rows.withColumn("idf", idf).select("query", "id", "kind", "term", "idf", part.alias("part"))


def top_per_kind(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query", "kind").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25(index: Index, asked: DataFrame) -> DataFrame:
    """(query, id, kind, score, matched) of the queries' terms (query, term), scores above 0."""
    return bm25_terms(index, asked).groupBy("query", "id", "kind").agg(F.sum("part").alias("score"), F.count("*").cast("int").alias("matched")).filter("score > 0")


def bm25_and_profile(index: Index, asked: DataFrame) -> DataFrame:
    """As ``bm25``, of (query, term, n), with ``dot``: the product of the document's counts with ``n``, the query's own (null: none)."""
    rows = asked_postings(index, asked)
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(index.average))))
    sums = [F.sum(part).alias("score"), F.count("*").cast("int").alias("matched"), F.sum(F.col("n") * tf).alias("dot")]
    return rows.groupBy("query", "id", "kind").agg(*sums).filter("score > 0")


def matched_terms(index: Index, asked: DataFrame) -> DataFrame:
    """(query, id, terms): the query's terms in a document, rarest first, joined by '|'."""
    rows = bm25_terms(index, asked).groupBy("query", "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("k"), "term"))).alias("t"))
    return rows.select("query", "id", F.concat_ws("|", F.col("t.term")).alias("terms"))


def cosine(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, kind, score) of every unit vector (id, kind, v) against up to MOST query vectors (query, vector)."""
    asked = queries.select("query", vectors.normalized(F.col("vector")).alias("q")).collect()
    if len(asked) > MOST:
        raise ValueError(f"more than {MOST} queries at once")
    local = units.sparkSession.createDataFrame([(r["query"], r["q"]) for r in asked], "query int, q array<double>")
    return units.join(F.broadcast(local)).select("query", "id", "kind", vectors.dot(F.col("v"), F.col("q")).alias("score"))


def channels(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """(query, id, kind, lex, vec): both channels' top ``k`` per kind, merged by id; null where a channel did not find the row."""
    found = top_per_kind(lexical, k).select("query", "id", "kind", F.col("score").alias("lex"), F.lit(None).cast("double").alias("vec"))
    found = found.unionByName(top_per_kind(semantic, k).select("query", "id", "kind", F.lit(None).cast("double").alias("lex"), F.col("score").alias("vec")))
    return found.groupBy("query", "id", "kind").agg(F.max("lex").alias("lex"), F.max("vec").alias("vec"))


def blend(cos: Column, lex: Column) -> Column:
    """0.7 vector + 0.3 lexical, the latter relative to the query's best; what is missing counts 0."""
    best = F.max(lex).over(W.partitionBy("query"))
    return 0.7 * F.coalesce(cos, F.lit(0.0)) + 0.3 * F.coalesce(lex / best, F.lit(0.0))


def seeds(found: DataFrame, sources: DataFrame, most: int = 12) -> DataFrame:
    """(query, id, seed_rank): the query's source (query, id) as 0, then the ``most`` best candidates by ``blend``; ties by id."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("b"), "id"))
    best = found.withColumn("b", F.round(blend(F.col("vec"), F.col("lex")), 8)).withColumn("seed_rank", rank).filter(F.col("seed_rank") <= most)
    return sources.select("query", "id", F.lit(0).alias("seed_rank")).unionByName(best.select("query", "id", "seed_rank"))


def candidates(found: DataFrame, reached: DataFrame, lexical: DataFrame, semantic: DataFrame, cap: int = 400) -> DataFrame:
    """The channels' rows and those the graph reached (query, id, kind, hops, seed, path), merged by id with all signals.

    Rows that a channel missed get its score if it has one. ``lexnorm`` is relative to the query's best candidate. Ordered by
    0.7 vector + 0.3 lexnorm, cut at ``cap`` a query. Adds channels, cos, lexnorm, matched, hops, seed, path.
    """
    names = [("lexical", F.col("lex")), ("vector", F.col("vec"))]
    one = found.select("query", "id", "kind", *[F.when(c.isNotNull(), n).alias(n) for n, c in names], F.lit(None).cast("string").alias("graph"), F.lit(None).cast("struct<hops:int,seed:long,path:string>").alias("way"))
    way = F.struct(F.col("hops").cast("int").alias("hops"), F.col("seed").cast("long").alias("seed"), F.col("path"))
    two = reached.select("query", "id", "kind", *[F.lit(None).cast("string").alias(n) for n, _ in names], F.lit("graph").alias("graph"), way.alias("way"))
    merged = one.unionByName(two).groupBy("query", "id", "kind").agg(F.max("lexical").alias("lexical"), F.max("vector").alias("vector"), F.max("graph").alias("graph"), F.max("way").alias("way"))
    full = merged.join(lexical.select("query", "id", F.col("score").alias("lex"), "matched"), ["query", "id"], "left").join(semantic.select("query", "id", F.col("score").alias("c")), ["query", "id"], "left")
    norm = F.coalesce(F.col("lex") / F.max("lex").over(W.partitionBy("query")), F.lit(0.0))
    rows = full.select("query", "id", "kind", F.concat_ws("+", "graph", "lexical", "vector").alias("channels"), F.coalesce("c", F.lit(0.0)).alias("cos"), norm.alias("lexnorm"), F.coalesce("matched", F.lit(0)).alias("matched"), "way.hops", "way.seed", "way.path")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round(0.7 * F.col("cos") + 0.3 * F.col("lexnorm"), 8)), "id"))
    return rows.withColumn("at", rank).filter(F.col("at") <= cap).drop("at")


def diagnostics(rows: DataFrame) -> DataFrame:
    """(query, total, graph, lexical, vector, several): how many candidates each channel found, and several of them."""
    has = {c: F.count_if(F.col("channels").contains(c)).alias(c) for c in ("graph", "lexical", "vector")}
    return rows.groupBy("query").agg(F.count("*").alias("total"), *has.values(), F.count_if(F.col("channels").contains("+")).alias("several"))


def counter_cosine(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of the term counts (id, term, tf) of each pair of documents; 0 where either has no term."""
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    left = pairs.distinct().join(counts.select(F.col("id").alias("a"), "term", F.col("tf").alias("x")), "a")
    dots = left.join(counts.select(F.col("id").alias("b"), "term", F.col("tf").alias("y")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    found = dots.join(norms.select(F.col("id").alias("a"), F.col("norm").alias("n")), "a").join(norms.select(F.col("id").alias("b"), F.col("norm").alias("m")), "b")
    return pairs.join(found.select("a", "b", (F.col("dot") / F.col("n") / F.col("m")).alias("c")), ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0.0)).alias("cosine"))
