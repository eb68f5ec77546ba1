"""The hybrid search over documents: three channels, six signals, penalties and ranks, and the same in DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import graph, index, retrieval, scoring
from ..sources.tables import document_edges, table
from ..storage import save

#: The searches: text, the vector they start from and the document they ask for company for.
SEARCHES = [(1, "the thing that was with this", 0, 10), (2, "für die und nicht von der", 1, 11), (3, "pour les dans une avec idiot", 2, 12)]
#: Groups of synonyms, terms of method, status scores, weights of the six signals.
SYNONYMS = (("idiot", "moron", "stupid"), ("with", "avec", "von der"))
METHODS = ("tion", "heit", "ment", "idiot")
STATUS = {"O": 1.0, "F": 0.3}
WEIGHTS = {"semantic": 0.35, "domain": 0.20, "method": 0.15, "graph": 0.10, "evidence": 0.10, "actionable": 0.10}

BIGRAMS_SQL = "list_concat({t}, [{t}[i] || ' ' || {t}[i + 1] FOR i IN range(1, greatest(len({t}), 1))])"
WORDS_SQL = "list_filter(regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[0-9a-z]+'), lambda x: len(x) > 2)"
TOKENS_SQL = f"toks AS (SELECT doc_id, lang, {WORDS_SQL.format(x='text')} AS t FROM documents)"
TERMS_SQL = f"{TOKENS_SQL}, sized AS (SELECT doc_id, lang, greatest(1, len(t)) AS len, t FROM toks), terms AS (SELECT doc_id, lang, len, unnest({BIGRAMS_SQL.format(t='t')}) AS term FROM sized), tf AS (SELECT doc_id, lang, len, term, count(*) AS tf FROM terms GROUP BY ALL)"
SEARCHES_SQL = "q0 AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}', {v}, {s})" for q, t, v, s in SEARCHES) + ") v(query, text, vec, source_id))"
ASKED_SQL = f"{SEARCHES_SQL}, q1 AS (SELECT query, {WORDS_SQL.format(x='text')} AS t FROM q0), q AS (SELECT DISTINCT query, unnest({BIGRAMS_SQL.format(t='t')}) AS term FROM q1)"


def _synonyms_sql() -> str:
    parts = []
    for group in SYNONYMS:
        words = sorted({*group, *(w for p in group for w in p.split())})
        fires = " OR ".join([f"list_has_any(base, {list(group)})", *(f"contains(array_to_string(list_sort(base), ' '), '{p}')" for p in group if " " in p)])
        parts.append(f"CASE WHEN {fires} THEN {words} ELSE []::VARCHAR[] END")
    return ", ".join(parts)


CONTEXT_SQL = f"""{SEARCHES_SQL}, q1 AS (SELECT query, q0.text, vec, source_id, d.source AS title, d.lang AS area, {WORDS_SQL.format(x='q0.text')} AS t, {WORDS_SQL.format(x='d.source')} AS s FROM q0 JOIN documents d ON doc_id = source_id),
q2 AS (SELECT *, list_distinct(list_concat({BIGRAMS_SQL.format(t='t')}, {BIGRAMS_SQL.format(t='s')})) AS base FROM q1),
q AS (SELECT DISTINCT query, unnest(list_concat(base, {_synonyms_sql()})) AS term FROM q2),
profile AS (SELECT query, term, CAST(sum(w) AS BIGINT) AS n FROM (SELECT query, unnest({BIGRAMS_SQL.format(t='t')}) AS term, 2 AS w FROM q1 UNION ALL SELECT query, unnest({BIGRAMS_SQL.format(t='s')}), 1 FROM q1) GROUP BY ALL)"""
LEX_SQL = "whole AS (SELECT count(*) AS n, avg(len) AS avg_len FROM sized), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), parts AS (SELECT query, doc_id AS id, lang AS kind, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS part FROM tf JOIN q USING (term) JOIN df USING (term), whole), lex AS (SELECT query, id, kind, sum(part) AS score, count(*) AS matched FROM parts GROUP BY ALL)"
BM25_SQL = f"{TERMS_SQL}, {ASKED_SQL}, {LEX_SQL}"
VEC_SQL = "unit AS (SELECT vec_id AS id, label::VARCHAR AS kind, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"
MIX_SQL = "mix AS (SELECT query, [0.65 * a.e[i] / a.norm + 0.35 * b.e[i] / b.norm FOR i IN range(1, len(a.e) + 1)] AS m FROM q0 JOIN unit a ON a.id = q0.vec JOIN unit b ON b.id = q0.source_id), cosine AS (SELECT query, u.id, u.kind, list_inner_product(u.e, m) / u.norm / sqrt(list_inner_product(m, m)) AS score FROM unit u, mix)"
RELATIONS_SQL = """rels AS (SELECT 'DO-' || doc_id AS src, 'DESCRIBES' AS rel, 'OR-' || o_orderkey AS dst, doc_id + 2 AS row, 'order' AS field FROM documents JOIN orders ON o_orderkey = doc_id
  UNION ALL SELECT 'DO-' || doc_id, 'CITES', 'DO-' || (doc_id // 2), doc_id + 2, 'cited' FROM documents WHERE doc_id > 0 AND doc_id // 2 IN (SELECT doc_id FROM documents)),
ends AS (SELECT src AS id, rel, dst AS other, 'OUTGOING' AS direction FROM rels UNION ALL SELECT dst, rel, src, 'INCOMING' FROM rels), nb AS (SELECT DISTINCT id, other FROM ends)"""
DECAY_SQL = "CASE {h} WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.0 END"
CANDIDATES_SQL = f"""WITH {TERMS_SQL}, {CONTEXT_SQL}, {LEX_SQL}, {VEC_SQL}, {MIX_SQL}, {RELATIONS_SQL},
l AS (SELECT query, id, kind, round(score, 8) AS score, matched FROM lex), c AS (SELECT query, id, d.lang AS kind, round(score, 8) AS score FROM cosine JOIN documents d ON d.doc_id = cosine.id),
found AS (SELECT query, id, kind, score AS lex, NULL AS vec FROM l QUALIFY row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) <= 30
  UNION ALL SELECT query, id, kind, NULL, score FROM c QUALIFY row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) <= 30),
pre AS (SELECT query, id, kind, max(lex) AS lex, max(vec) AS vec FROM found GROUP BY ALL),
blended AS (SELECT query, id, round(0.7 * coalesce(vec, 0) + 0.3 * coalesce(lex / max(lex) OVER (PARTITION BY query), 0), 8) AS b FROM pre),
sd AS (SELECT query, source_id AS id, 0 AS seed_rank FROM q0 UNION ALL SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY b DESC, id) FROM blended QUALIFY row_number() OVER (PARTITION BY query ORDER BY b DESC, id) <= 12),
step AS (SELECT DISTINCT id, other, CASE direction WHEN 'OUTGOING' THEN ' -' || rel || '-> ' ELSE ' <-' || rel || '- ' END || other AS step FROM ends),
one AS (SELECT query, other AS id, 1 AS hops, seed_rank, step.id AS seed, step.id || step AS path FROM sd JOIN step ON step.id = 'DO-' || sd.id),
two AS (SELECT * FROM one UNION ALL SELECT query, step.other, 2, seed_rank, seed, path || step FROM one JOIN step USING (id)),
way AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY hops, seed_rank, path) = 1),
reached AS (SELECT way.query, d.doc_id AS id, d.lang AS kind, hops, CAST(substr(seed, 4) AS BIGINT) AS seed, path FROM way JOIN documents d ON way.id = 'DO-' || d.doc_id JOIN q0 ON q0.query = way.query WHERE d.doc_id <> q0.source_id),
ch AS (SELECT query, id, kind, 'graph' AS channel FROM reached UNION SELECT query, id, kind, 'lexical' FROM pre WHERE lex IS NOT NULL UNION SELECT query, id, kind, 'vector' FROM pre WHERE vec IS NOT NULL),
m AS (SELECT query, id, kind, string_agg(channel, '+' ORDER BY channel) AS channels FROM ch GROUP BY ALL),
n AS (SELECT m.*, coalesce(c.score, 0.0) AS cos, coalesce(l.score / max(l.score) OVER (PARTITION BY m.query), 0.0) AS lexnorm, coalesce(l.matched, 0) AS matched, r.hops, r.seed, r.path
  FROM m LEFT JOIN l ON l.query = m.query AND l.id = m.id LEFT JOIN c ON c.query = m.query AND c.id = m.id LEFT JOIN reached r ON r.query = m.query AND r.id = m.id),
cand AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * cos + 0.3 * lexnorm, 8) DESC, id) <= 400)"""
METHODS_SQL = "list_filter({m}, lambda t: contains(lower(strip_accents(coalesce({x}, ''))), t))"
SIGNALS_SQL = f"""{CANDIDATES_SQL}, dots AS (SELECT query, doc_id AS id, sum(n * tf) AS dot FROM profile JOIN tf USING (term) GROUP BY ALL), qn AS (SELECT query, sqrt(sum(n * n)) AS norm FROM profile GROUP BY 1), dn AS (SELECT doc_id AS id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1),
deg AS (SELECT id, count(*) AS degree, count(*) FILTER (rel = 'CITES' AND direction = 'INCOMING') AS cited, count(*) FILTER (rel = 'DESCRIBES') AS described FROM ends GROUP BY 1),
h1 AS (SELECT DISTINCT q0.query, nb.other AS id, 1 AS hops FROM q0 JOIN nb ON nb.id = 'DO-' || source_id), h2 AS (SELECT DISTINCT query, nb.other AS id, 2 AS hops FROM h1 JOIN nb USING (id)), h3 AS (SELECT DISTINCT query, nb.other AS id, 3 AS hops FROM h2 JOIN nb USING (id)),
far AS (SELECT query, id, min(hops) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL),
sizes AS (SELECT id, count(*) AS n FROM nb GROUP BY 1),
shared AS (SELECT cand.query, cand.id, count(*) AS n FROM cand JOIN q0 ON q0.query = cand.query JOIN nb a ON a.id = 'DO-' || source_id JOIN nb b ON b.id = 'DO-' || cand.id AND b.other = a.other GROUP BY ALL),
ref AS (SELECT max(year(o_orderdate)) AS reference FROM orders), grades AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
raw AS (SELECT cand.*, d.text, d.source, q1.title, q1.area, 0.7 * least(1, greatest(0, (cos - 0.25) / (0.85 - 0.25))) + 0.3 * lexnorm AS semantic,
  CAST(d.source = q1.title AS INTEGER) AS inst, CASE WHEN dn.norm > 0 THEN coalesce(dot, 0) / dn.norm / qn.norm END AS topical, CAST(d.lang = q1.area AS INTEGER) AS same_area,
  {METHODS_SQL.format(m=list(METHODS), x='q1.text')} AS qm, {METHODS_SQL.format(m=list(METHODS), x='d.text')} AS dm,
  greatest({DECAY_SQL.format(h='CASE WHEN cand.id = q0.source_id THEN 0 ELSE far.hops END')}, 0.75 * {DECAY_SQL.format(h='cand.hops')}) AS near, coalesce(deg.degree, 0) AS degree, coalesce(deg.cited, 0) AS cited, coalesce(deg.described, 0) AS described,
  coalesce(shared.n, 0) AS common, coalesce(zc.n, 0) AS nc, coalesce(zs.n, 0) AS ns, o_orderstatus AS status, year(o_orderdate) AS year, reference, grades.quality, grades.toxic
  FROM cand JOIN q0 USING (query) JOIN q1 USING (query) JOIN qn USING (query) JOIN documents d ON d.doc_id = cand.id LEFT JOIN dn ON dn.id = cand.id LEFT JOIN dots ON dots.query = cand.query AND dots.id = cand.id
  LEFT JOIN deg ON deg.id = 'DO-' || cand.id LEFT JOIN far ON far.query = cand.query AND far.id = 'DO-' || cand.id LEFT JOIN shared ON shared.query = cand.query AND shared.id = cand.id
  LEFT JOIN sizes zc ON zc.id = 'DO-' || cand.id LEFT JOIN sizes zs ON zs.id = 'DO-' || q0.source_id LEFT JOIN orders ON o_orderkey = cand.id LEFT JOIN grades ON grades.doc_id = cand.id, ref),
sig AS (SELECT *, (0.35 * inst + 0.4 * coalesce(topical, 0) + 0.25 * same_area) / CASE WHEN topical IS NULL THEN 0.6 ELSE 1 END AS domain,
  CASE WHEN len(qm) > 0 THEN len(list_intersect(qm, dm)) / len(qm)::DOUBLE ELSE least(0.75, CASE WHEN len(dm) > 0 THEN 0.5 ELSE 0 END + 0.5 * least(1, len(dm) / 3.0)) END AS method,
  least(1, 0.45 * near + 0.35 * least(1, ln(1 + degree) / ln(13)) + 0.2 * greatest(CASE WHEN nc + ns - common > 0 THEN common / (nc + ns - common)::DOUBLE ELSE 0 END, CASE WHEN ns > 0 THEN common / ns::DOUBLE ELSE 0 END)) AS graph,
  0.5 * (CAST(coalesce(trim(text), '') <> '' AS INTEGER) + CAST(coalesce(trim(source), '') <> '' AS INTEGER) + CAST(coalesce(trim(kind), '') <> '' AS INTEGER)) / 3.0 + 0.2 * 2 / 3.0 + 0.2 * least(1, degree / 3.0) + 0.1 * least(1, described) AS evidence,
  (0.35 * CASE status WHEN 'O' THEN 1.0 WHEN 'F' THEN 0.3 ELSE 0.7 END + 0.25 * coalesce(pow(0.5, greatest(0, reference - year) / 6.0), 0) + 0.1 * least(1, cited / 2.0)) / CASE WHEN year IS NULL THEN 0.45 ELSE 0.7 END AS actionable,
  coalesce(status = 'F', false) OR coalesce(toxic = 1, false) AS inactive FROM raw),
pen AS (SELECT *, CASE WHEN inactive THEN 0.15 ELSE 0.0 END AS a1, CASE WHEN evidence < 0.3 THEN 0.1 ELSE 0.0 END AS a2, CASE WHEN semantic < 0.35 AND matched <= 1 AND near <= 0 THEN 0.08 ELSE 0.0 END AS a3, CASE WHEN domain <= 0 AND semantic < 0.55 THEN 0.1 ELSE 0.0 END AS a4 FROM sig),
scaled AS (SELECT *, CASE WHEN a1 + a2 + a3 + a4 > 0.35 THEN 0.35 / (a1 + a2 + a3 + a4) ELSE 1.0 END AS f FROM pen),
lost AS (SELECT *, round(a1 * f, 4) AS p_inactive, round(a2 * f, 4) AS p_thin, round(a3 * f, 4) AS p_superficial, round(a4 * f, 4) AS p_mismatch FROM scaled),
base AS (SELECT *, p_inactive + p_thin + p_superficial + p_mismatch AS penalty, {' + '.join(f'{w} * {s}' for s, w in WEIGHTS.items())} AS weighted FROM lost),
first AS (SELECT *, round(least(1, greatest(0, weighted - penalty)), 6) AS total1 FROM base),
ranked1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total1 DESC, id) AS rank1 FROM first),
top AS (SELECT query, kind, id, rank1 FROM ranked1 WHERE rank1 <= 50),
prs AS (SELECT a.query, a.id, b.id AS other FROM top a JOIN top b ON a.query = b.query AND a.kind = b.kind AND b.rank1 < a.rank1),
alike AS (SELECT a, b FROM (SELECT p.a, p.b, sum(x.tf * y.tf) AS dot FROM (SELECT DISTINCT id AS a, other AS b FROM prs) p JOIN tf x ON x.doc_id = p.a JOIN tf y ON y.doc_id = p.b AND y.term = x.term GROUP BY ALL) z JOIN dn u ON u.id = a JOIN dn v ON v.id = b WHERE dot / u.norm / v.norm >= 0.92),
dup AS (SELECT DISTINCT query, id FROM prs JOIN alike ON alike.a = prs.id AND alike.b = prs.other),
cut AS (SELECT r.*, CASE WHEN dup.id IS NULL THEN 0.0 ELSE 0.06 END AS redundancy, round(greatest(0, total1 - CASE WHEN dup.id IS NULL THEN 0.0 ELSE 0.06 END), 6) AS total FROM ranked1 r LEFT JOIN dup ON dup.query = r.query AND dup.id = r.id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY total DESC, id) AS INTEGER) AS rank FROM cut)"""
HYBRID_SQL = f"""{SIGNALS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY rank) AS in_kind FROM ranked),
sel AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY CAST(in_kind > 2 AS INTEGER), rank) AS INTEGER) AS place FROM k),
level AS (SELECT query, CASE WHEN semantic < 0.45 OR total < 0.55 THEN 'low' WHEN total >= 0.7 THEN 'high' ELSE 'medium' END AS confidence FROM sel WHERE place = 1)"""


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("title"), "text")


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query int, text string, vec long, source_id long")


def units(spark: SparkSession, d: str) -> DataFrame:
    return index.units_of(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "embedding"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(query, vector): each search's own vector mixed with that of its source document."""
    own = units(spark, d)
    asked = searches(spark).join(own.select(F.col("id").alias("vec"), F.col("v").alias("a")), "vec")
    asked = asked.join(own.select(F.col("id").alias("source_id"), F.col("v").alias("b")), "source_id")
    return asked.select("query", vectors.mixed(F.col("a"), F.col("b")).alias("vector"))


@dataclass
class Context:
    """What the searches ask: ``queries`` (query, text, source_id, title, area, base, terms), ``terms`` (query, term, n), where n counts a
    term in the query's profile and is null for synonyms."""

    queries: DataFrame
    terms: DataFrame


def context(spark: SparkSession, d: str) -> Context:
    """Terms of the searches and of their sources' titles, expanded by synonyms; the profile counts a search's own terms twice."""
    source = index.index_of(docs_of(spark, d)).documents.select(F.col("id").alias("source_id"), "title", F.col("kind").alias("area"))
    own = [text.tokenize(F.col(c)) for c in ("text", "title")]
    grams = [F.concat(t, text.bigrams(t)) for t in own]
    rows = source.join(F.broadcast(searches(spark)), "source_id").withColumn("base", F.array_distinct(F.concat(*grams)))
    rows = rows.withColumn("terms", retrieval.expanded(F.col("base"), SYNONYMS)).withColumn("counted", F.concat(grams[0], grams[0], grams[1]))
    found = rows.collect()  # a row for each search
    terms = [(r["query"], t, r["counted"].count(t) or None) for r in found for t in r["terms"]]
    return Context(spark.createDataFrame(found, rows.schema).drop("counted", "vec"), spark.createDataFrame(terms, "query int, term string, n long"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """The documents' edges, saved when first asked for."""
    return index.once([table(spark, d, "documents"), table(spark, d, "orders")], "links", lambda: save(document_edges(spark, d)))


def beside(spark: SparkSession, d: str) -> DataFrame:
    return index.once([table(spark, d, "documents"), table(spark, d, "orders")], "beside", lambda: save(graph.near_of(links(spark, d))))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return index.once([table(spark, d, "documents"), table(spark, d, "orders")], "steps", lambda: save(graph.steps_of(links(spark, d))))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    """(id, degree, cited, described) of every node of the documents' edges."""

    def make():
        ends = graph.adjacency(links(spark, d)).groupBy("id")
        return save(ends.agg(F.count("*").alias("degree"), F.count_if((F.col("rel") == "CITES") & (F.col("direction") == "INCOMING")).alias("cited"), F.count_if(F.col("rel") == "DESCRIBES").alias("described")))

    return index.once([table(spark, d, "documents"), table(spark, d, "orders")], "degrees", make)


def reference_year(spark: SparkSession, d: str) -> int:
    """The latest sane year of an order, or 2026; never the clock."""
    orders, year = table(spark, d, "orders"), F.year("o_orderdate")
    return index.once(orders, "year", lambda: orders.agg(F.max(F.when(year.between(1901, 2199), year))).first()[0] or 2026)


def seed_rows(found: DataFrame, asked: Context) -> DataFrame:
    return retrieval.seeds(found, asked.queries.select("query", F.col("source_id").alias("id")))


def found_rows(spark: SparkSession, d: str, asked: Context) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved: what the lexical and the vector channel say of every document, and the best of both."""
    own = index.index_of(docs_of(spark, d))
    lexical = save(retrieval.bm25_and_profile(own, asked.terms).withColumn("score", F.round("score", 8)))
    near = retrieval.cosine(units(spark, d), query_vectors(spark, d)).drop("kind").join(own.documents.select("id", "kind"), "id")
    near = save(near.select("query", "id", "kind", F.round("score", 8).alias("score")))
    return lexical, near, save(retrieval.channels(lexical, near, 30))


def reached_rows(spark: SparkSession, d: str, found: DataFrame, asked: Context) -> DataFrame:
    """(query, id, kind, hops, seed, path): documents within two steps of the seeds, but for the source itself."""
    kinds = index.index_of(docs_of(spark, d)).documents.select("id", "kind")
    start = seed_rows(found, asked).withColumn("id", F.concat(F.lit("DO-"), F.col("id").cast("string")))
    number = lambda c: F.substring(F.col(c), 4, 20).cast("long")
    rows = graph.expand(steps(spark, d), F.broadcast(start), ("query",)).filter(F.col("id").startswith("DO-"))  # 13 rows a search at most
    rows = rows.select("query", number("id").alias("id"), "hops", number("seed").alias("seed"), "path").join(kinds, "id")
    return rows.join(F.broadcast(asked.queries.select("query", F.col("source_id").alias("id"))), ["query", "id"], "left_anti")


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, Context]:
    """Saved candidates of all three channels with what each channel says, and the searches' context."""
    asked = context(spark, d)
    lexical, near, found = found_rows(spark, d, asked)
    rows = retrieval.candidates(found, reached_rows(spark, d, found, asked), lexical.drop("dot"), near)
    return save(rows.join(lexical.select("query", "id", "dot"), ["query", "id"], "left")), asked


def signals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with their six signals, the penalties, and what those are made of; and their saved texts, which are read once."""
    rows, asked = candidates(spark, d)
    own = index.index_of(docs_of(spark, d))
    ids = [r["id"] for r in rows.select("id").distinct().collect()]  # 400 a search at most
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "id long"))
    texts = save(docs_of(spark, d).join(wanted, "id", "left_semi"))
    facts = texts.select("id", "title", text.lexicon_hits(F.col("text"), METHODS).alias("dm"), (F.trim("text") != "").alias("filled"))
    length = F.aggregate(F.collect_list("n"), F.lit(0.0), lambda s, n: s + n * n)
    norms = asked.terms.filter("n is not null").groupBy("query").agg(F.sqrt(length).alias("q_norm"))
    asks = asked.queries.select("query", F.col("text").alias("q_text"), "source_id", F.col("title").alias("q_title"), "area").join(norms, "query")
    rows = rows.join(facts, "id").join(F.broadcast(asks), "query").join(own.documents.select("id", "norm").join(wanted, "id", "left_semi"), "id")
    name = lambda c: F.concat(F.lit("DO-"), F.col(c).cast("string"))
    pairs = rows.select(name("source_id").alias("seed"), name("id").alias("id")).distinct()
    start = asked.queries.select(name("source_id").alias("id")).distinct()
    far = graph.walk(links(spark, d), start, 3, beside(spark, d), few=True).select("seed", "id", F.col("hops").alias("far"))
    company = graph.shared_neighbors(links(spark, d), pairs, beside(spark, d)).join(far, ["seed", "id"], "left").join(degrees(spark, d), "id", "left")
    company = company.select(F.substring("seed", 4, 20).cast("long").alias("source_id"), F.substring("id", 4, 20).cast("long").alias("id"), "shared", "either", "mine", "far", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "cited", "described")])
    rows = rows.join(company, ["source_id", "id"])
    orders, reference = table(spark, d, "orders"), reference_year(spark, d)
    rows = rows.join(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).join(wanted, "id", "left_semi"), "id", "left")
    grades = table(spark, d, "labels").join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(grades, "id", "left")
    rows = rows.withColumn("semantic", scoring.semantic(F.col("cos"), F.col("lexnorm")))
    topical = F.when(F.col("norm") > 0, F.coalesce("dot", F.lit(0)) / F.col("norm") / F.col("q_norm"))
    rows = rows.withColumn("domain", scoring.domain(F.array("q_title"), F.array("title"), topical, F.array("area"), F.array("kind")))
    rows = rows.withColumn("method", scoring.method(text.lexicon_hits(F.col("q_text"), METHODS), F.col("dm")))
    bridge = F.greatest(F.coalesce(F.try_divide("shared", "either"), F.lit(0.0)), F.coalesce(F.try_divide("shared", "mine"), F.lit(0.0)))
    rows = rows.withColumn("near", F.greatest(scoring.proximity(F.col("far")), 0.75 * scoring.proximity(F.col("hops"))))
    rows = rows.withColumn("graph", scoring.graph(F.col("far"), F.col("degree"), bridge, F.col("hops")))
    proof = [F.when(F.col("filled"), F.lit("text")), F.col("title"), F.col("kind")]
    rows = rows.withColumn("evidence", scoring.evidence(proof, [F.lit("documents"), F.col("id"), F.lit("")], F.col("degree"), F.least(F.lit(1), F.col("described"))))
    none = F.lit(None).cast("double")
    rows = rows.withColumn("actionable", scoring.actionable(F.col("status"), STATUS, F.col("year"), F.lit(reference), none, F.least(F.lit(1.0), F.col("cited") / 2), none))
    inactive = F.coalesce(F.col("status") == "F", F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    lost = scoring.penalties(inactive, F.col("evidence"), F.col("semantic"), F.col("matched"), F.col("near"), F.col("domain"), F.col("area").isNotNull())
    for part, value in lost.items():
        rows = rows.withColumn(f"p_{part}", value)
    return rows.withColumn("penalty", sum((F.col(f"p_{x}") for x in list(lost)[1:]), F.col(f"p_{next(iter(lost))}"))), texts


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One saved row for each candidate: channels, signals, penalties, base, redundancy, total and rank.

    The table of the registered searches is kept for the queries that report on it; ``index.forget("scored")`` makes them search anew.
    """

    def make():
        rows, texts = signals(spark, d)
        base = sum((F.col(s) * w for s, w in list(WEIGHTS.items())[1:]), F.col("semantic") * WEIGHTS["semantic"])
        rows = rows.withColumn("weighted", base).withColumn("total", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weighted") - F.col("penalty"))), 6))
        rows = save(scoring.ranked(rows))
        first = rows.filter("rank <= 50").select("id").distinct()
        return save(scoring.redundancy(rows, index.postings(texts.join(F.broadcast(first), "id", "left_semi"))))

    files = [table(spark, d, name) for name in ("documents", "embeddings", "orders", "labels")]
    return index.once(files, "scored", make)


def selected(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return scoring.diversified(scored(spark, d), k)
