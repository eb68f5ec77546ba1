"""Registered queries on what a search found: context, seeds, paths, penalties, evidence, subgraph and payloads; and on the dataset's
checks and documents. Each is beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, typed, vectors
from ..operators import evidence, retrieval, validation
from ..sources.tables import document_edges, identifier, table
from .catalog import query
from .connections import RELATIONS, _related
from .search import CANDIDATES_SQL, CONTEXT_SQL, HYBRID_SQL, RELATIONS_SQL, SEARCHES_SQL, SIGNALS_SQL, VEC_SQL, context, found_rows, links, scored, searches, seed_rows, selected, units

RELATION_SQL = "CASE WHEN channels = 'graph' THEN 'CONNECTED_TO' WHEN len(qm) > 0 AND method >= 0.6 AND method - greatest(semantic, domain) >= 0.25 THEN 'SHARES_METHOD' WHEN status = 'F' THEN 'ANTECEDENT_OF' ELSE coalesce(CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items()) + " END, 'RELATED_TO') END"

# The query


@query(f"WITH {CONTEXT_SQL} SELECT query, term, CAST(n AS BIGINT) AS in_profile FROM q LEFT JOIN profile USING (query, term)")
def query_context(spark, d):
    """Terms of the searches with their synonyms, and how often the profile counts each."""
    return context(spark, d).terms.select("query", "term", F.col("n").alias("in_profile"))


@query(f"WITH {CONTEXT_SQL}, x AS (SELECT query, count(*) AS terms FROM q GROUP BY 1) SELECT query, text, source_id, title, CAST(len(base) AS INTEGER) AS base_terms, CAST(terms - len(base) AS INTEGER) AS expanded FROM q2 JOIN x USING (query)")
def query_description(spark, d):
    rows = context(spark, d).queries
    return rows.select("query", "text", "source_id", "title", F.size("base").alias("base_terms"), F.size(F.array_except("terms", "base")).alias("expanded"))


@query(f"{CANDIDATES_SQL} SELECT query, id, CAST(seed_rank AS INTEGER) AS seed_rank FROM sd")
def seed_selection(spark, d):
    asked = context(spark, d)
    return seed_rows(found_rows(spark, d, asked)[2], asked)


@query(f"{CANDIDATES_SQL} SELECT query, id, hops, seed, path FROM cand WHERE contains(channels, 'graph')")
def graph_channel(spark, d):
    return scored(spark, d).filter(F.col("channels").contains("graph")).select("query", "id", "hops", "seed", "path")


@query(f"{CANDIDATES_SQL} SELECT query, count(*) AS total, count(*) FILTER (contains(channels, 'graph')) AS graph, count(*) FILTER (contains(channels, 'lexical')) AS lexical, count(*) FILTER (contains(channels, 'vector')) AS vector, count(*) FILTER (contains(channels, '+')) AS several FROM cand GROUP BY query")
def retrieval_diagnostics(spark, d):
    return retrieval.diagnostics(scored(spark, d))


@query(f"WITH {SEARCHES_SQL}, {VEC_SQL} SELECT query, round(list_inner_product(a.e, b.e) / a.norm / b.norm, 4) AS similarity FROM q0 JOIN unit a ON a.id = vec JOIN unit b ON b.id = source_id")
def point_similarity(spark, d):
    own = units(spark, d)
    rows = searches(spark).join(own.select(F.col("id").alias("vec"), F.col("v").alias("a")), "vec").join(own.select(F.col("id").alias("source_id"), F.col("v").alias("b")), "source_id")
    return rows.select("query", F.round(vectors.dot(F.col("a"), F.col("b")), 4).alias("similarity"))


# Scores


@query(f"{SIGNALS_SQL} SELECT query, id, p_inactive, p_thin, p_superficial, p_mismatch, round(weighted, 4) AS base FROM ranked")
def penalties(spark, d):
    return scored(spark, d).select("query", "id", "p_inactive", "p_thin", "p_superficial", "p_mismatch", F.round("weighted", 4).alias("base"))


@query(f"{SIGNALS_SQL} SELECT query, id, degree, cited, round(near, 4) AS near, common, nc + ns - common AS either, round(topical, 4) AS topical, inst, same_area FROM ranked")
def signal_details(spark, d):
    rows = scored(spark, d)
    topical = F.when(F.col("norm") > 0, F.coalesce("dot", F.lit(0)) / F.col("norm") / F.col("q_norm"))
    same = [(F.col(a) == F.col(b)).cast("int") for a, b in (("title", "q_title"), ("kind", "area"))]
    return rows.select("query", "id", "degree", "cited", F.round("near", 4).alias("near"), F.col("shared").alias("common"), "either", F.round(topical, 4).alias("topical"), same[0].alias("inst"), same[1].alias("same_area"))


# Evidence


@query(f"{HYBRID_SQL} SELECT query, sel.id, rel, direction, other, 'documents:' || row || ':' || field AS fact FROM sel JOIN (SELECT src AS node, rel, 'OUTGOING' AS direction, dst AS other, row, field FROM rels UNION ALL SELECT dst, rel, 'INCOMING', src, row, field FROM rels) e ON e.node = 'DO-' || sel.id WHERE place <= 10")
def relation_evidence(spark, d):
    """Facts of the relations that the selected documents take part in, each with the record that states it."""
    chosen = selected(spark, d).select("query", "id", identifier("DO", "id").alias("node"))
    return evidence.facts(chosen, links(spark, d)).select("query", "id", "rel", "direction", "other", "fact")


@query(f"{HYBRID_SQL} SELECT query, id, path FROM sel WHERE place <= 10 AND path IS NOT NULL")
def path_evidence(spark, d):
    return selected(spark, d).filter("path IS NOT NULL").select("query", "id", "path")


@query(f"{HYBRID_SQL}, f AS (SELECT query, sel.id, count(*) AS facts FROM sel JOIN rels ON src = 'DO-' || sel.id OR dst = 'DO-' || sel.id WHERE place <= 10 GROUP BY ALL) SELECT query, count(*) AS selected, count(*) FILTER (coalesce(facts, 0) > 0) AS with_facts, round(avg(CASE WHEN coalesce(facts, 0) > 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage, bool_and(coalesce(facts, 0) > 0) AS all_traceable FROM sel LEFT JOIN f USING (query, id) WHERE place <= 10 GROUP BY query")
def evidence_coverage(spark, d):
    chosen = selected(spark, d).select("query", "id", identifier("DO", "id").alias("node"))
    return evidence.coverage(chosen, evidence.facts(chosen, links(spark, d))).withColumn("coverage", F.round("coverage", 4))


@query(f"{HYBRID_SQL}, f AS (SELECT DISTINCT query, sel.id FROM sel JOIN rels ON src = 'DO-' || sel.id OR dst = 'DO-' || sel.id WHERE place <= 10 AND rel = 'DESCRIBES') SELECT query, id, place FROM sel JOIN f USING (query, id) WHERE place <= 10")
def with_evidence_only(spark, d):
    """Selected rows without a described order are dropped."""
    chosen = selected(spark, d)
    ends = links(spark, d).filter("rel = 'DESCRIBES'").select(F.col("src").alias("node")).distinct()
    return chosen.withColumn("node", identifier("DO", "id")).join(ends, "node", "left_semi").select("query", "id", "place")


# The response


@query(f"""{HYBRID_SQL}, bridge AS (SELECT query, unnest(regexp_extract_all(path, '[A-Z]{{2}}-[0-9]+')) AS node, rank FROM sel WHERE place <= 10 AND path IS NOT NULL),
p AS (SELECT query, 'DO-' || source_id AS node, 0 AS turn, 0 AS rank FROM q0 UNION ALL SELECT query, 'DO-' || id, 1, rank FROM sel WHERE place <= 10 UNION ALL SELECT query, node, 2, rank FROM bridge),
u AS (SELECT query, node, min((turn, rank)) AS o FROM p GROUP BY ALL), nd AS (SELECT query, node FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY o, node) <= 20),
inf AS (SELECT sel.query, 'DO-' || q0.source_id AS src, {RELATION_SQL} AS rel, 'DO-' || sel.id AS dst, 'INFERRED' AS origin FROM sel JOIN q0 USING (query) WHERE place <= 10 AND sel.id <> q0.source_id),
exp AS (SELECT DISTINCT a.query, src, rel, dst, 'EXPLICIT' AS origin FROM rels JOIN nd a ON a.node = src JOIN nd b ON b.node = dst AND b.query = a.query)
SELECT i.* FROM inf i JOIN nd a ON a.query = i.query AND a.node = src JOIN nd b ON b.query = i.query AND b.node = dst UNION ALL SELECT * FROM exp""")
def response_subgraph(spark, d):
    """Edges among at most 20 nodes of each response: inferred from the source to what was selected, and explicit ones."""
    chosen = _related(selected(spark, d))
    source = context(spark, d).queries.select("query", identifier("DO", "source_id").alias("source"))
    rows = chosen.select("query", identifier("DO", "id").alias("node"), "rank", "relation", F.regexp_extract_all("path", F.lit("([A-Z]{2}-[0-9]+)"), F.lit(1)).alias("bridge"))
    return evidence.subgraph(rows, source, links(spark, d), 20)


@query(f"{HYBRID_SQL} SELECT query, 'CONN-DO-' || q0.source_id || '-DO-' || sel.id AS connection, place, round(total, 4) AS total, round(cos, 4) AS vector_score, round(lexnorm, 4) AS lexical_score, matched FROM sel JOIN q0 USING (query) WHERE place <= 10")
def connection_payload(spark, d):
    name = F.concat_ws("-", F.lit("CONN"), identifier("DO", "source_id"), identifier("DO", "id"))
    return selected(spark, d).select("query", name.alias("connection"), "place", F.round("total", 4).alias("total"), F.round("cos", 4).alias("vector_score"), F.round("lexnorm", 4).alias("lexical_score"), "matched")


@query(f"{HYBRID_SQL} SELECT query, kind, id, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS support FROM (SELECT * FROM sel WHERE place <= 10 QUALIFY row_number() OVER (PARTITION BY query, kind ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 5")
def support_selection(spark, d):
    """The first connection of each kind, five a search at most."""
    first = F.row_number().over(W.partitionBy("query", "kind").orderBy("rank"))
    rows = selected(spark, d).withColumn("first", first).filter("first = 1")
    return rows.withColumn("support", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter("support <= 5").select("query", "kind", "id", "support")


# The dataset


@query("SELECT 'CU-' || c_custkey AS id, 'customer' AS file, CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS BIGINT) AS row FROM customer UNION ALL SELECT 'PT-' || p_partkey, 'part', CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS BIGINT) FROM part")
def node_rows(spark, d):
    """Nodes with the number of their record, the header being the first."""
    parts = []
    for name, key, prefix in (("customer", "c_custkey", "CU"), ("part", "p_partkey", "PT")):
        rows = evidence.numbered(table(spark, d, name).select(key), [F.col(key)], 2)
        parts.append(rows.select(identifier(prefix, key).alias("id"), F.lit(name).alias("file"), "row"))
    return parts[0].unionByName(parts[1])


@query(f"WITH {RELATIONS_SQL} SELECT src, rel, dst, row, field FROM rels")
def describes_edges(spark, d):
    return document_edges(spark, d).select("src", "rel", "dst", "row", "field")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'order' WHEN 2 THEN 'part' ELSE 'ghost' END AS type, CASE WHEN doc_id % 4 = 3 THEN 'unknown type' ELSE 'missing entity' END AS problem FROM documents WHERE doc_id % 4 = 3 OR (doc_id % 4 = 0 AND doc_id * 7 NOT IN (SELECT c_custkey FROM customer)) OR (doc_id % 4 = 1 AND doc_id * 7 NOT IN (SELECT o_orderkey FROM orders)) OR (doc_id % 4 = 2 AND doc_id * 7 NOT IN (SELECT p_partkey FROM part))")
def document_entities(spark, d):
    """Documents whose declared entity is of no known type or is not there."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("customer", "order", "part", "ghost")]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", kind.alias("type"), (F.col("doc_id") * 7).alias("entity"))
    keys = {"customer": ("customer", "c_custkey"), "order": ("orders", "o_orderkey"), "part": ("part", "p_partkey")}
    return validation.broken_documents(docs, {k: table(spark, d, t).select(F.col(c).alias("entity")) for k, (t, c) in keys.items()}).select("doc_id", "type", "problem")


@query("SELECT page_id, list_last(string_split(replace(url, chr(92), '/'), '/')) AS name FROM pages")
def basename(spark, d):
    return table(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("name"))


@query("SELECT p_partkey, 'Name' AS field, trim(p_name) AS value FROM part WHERE trim(p_name) <> '' UNION ALL SELECT p_partkey, 'Brand', trim(p_brand) FROM part WHERE trim(p_brand) <> '' UNION ALL SELECT p_partkey, 'Size', p_size::VARCHAR FROM part")
def citable_fields(spark, d):
    rows = table(spark, d, "part")
    return evidence.citable(rows, "p_partkey", {"Name": F.col("p_name"), "Brand": F.col("p_brand"), "Size": F.col("p_size").cast("string")})


@query("SELECT o_orderkey, round_even((o_orderkey % 1000)::DOUBLE / 8, 2) AS rounded FROM orders")
def round_half_even(spark, d):
    """Halves, exact in binary, go to the even digit."""
    return table(spark, d, "orders").select("o_orderkey", F.bround((F.col("o_orderkey") % 1000).cast("double") / 8, 2).alias("rounded"))


@query("""SELECT event_id, coalesce(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k'), CASE WHEN json_valid(props) THEN NULL ELSE props END) AS k FROM events""")
def tolerant_json(spark, d):
    """A property of JSON; text that is no JSON is kept as it is."""
    return table(spark, d, "events").select("event_id", typed.json_or_raw(F.col("props"), "k").alias("k"))
