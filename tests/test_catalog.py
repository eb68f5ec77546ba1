"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding, text, typed, vectors
from tessera.operators import counts, evidence, graph, index, retrieval, scoring, validation
from tessera.plans import catalog
from tessera.sources.tables import read_csv, read_json_lines
from tessera.streaming.resume import follow

DATA = "/root/testdata/sf0.001"
TABLES = [p.removesuffix(".parquet") for p in os.listdir(DATA) if p.endswith(".parquet")] if os.path.isdir(DATA) else []


def cell(x):
    if x is None or x != x:
        return ""
    return round(float(x), 6) if hasattr(x, "__float__") and not isinstance(x, (bool, str)) else str(x)


@pytest.mark.skipif(not TABLES, reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda source: sorted((tuple(cell(x) for x in r) for r in source), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_tokens_keep_repeats_and_bigrams_bridge_stopwords(spark):
    row = spark.createDataFrame([("Ünï THE cafés, the cafés of it 42 abc",), (None,)], "t string")
    tokens = text.tokenize(F.col("t"), ("the",))
    got = row.select(tokens, text.bigrams(tokens)).collect()
    assert got[0][0] == ["uni", "cafes", "cafes", "abc"] and got[0][1] == ["uni cafes", "cafes cafes", "cafes abc"]
    assert got[1][0] == [] and got[1][1] == []


def test_missing_signal_gives_its_weight_away(spark):
    row = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in row.select(scoring.weighted_available((F.col("a"), 0.4), (F.col("b"), 0.6))).collect()] == pytest.approx([0.5, 0.0, 0.4])


def test_walk_stops_and_skips_dangling_edges(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "r", "ghost"), ("a", "r", "b")], "src string, rel string, dst string")
    nodes = spark.createDataFrame([(x, "N", x) for x in "abcd"], "id string, label string, title string")
    one = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["hops"]) for r in graph.walk(edges, one, 2).collect()} == {("a", 0), ("b", 1), ("ghost", 1), ("c", 2)}
    assert [r["other"] for r in graph.neighbors(edges, nodes, one).collect()] == ["b", "b"]
    assert {r["id"]: r["degree"] for r in graph.degree(edges).collect()}["a"] == 3


def test_vectors_and_checks(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert row.select(vectors.normalized(F.col("a")), vectors.normalized(F.col("b"))).first()[:] == ([0.6, 0.8], [0.0, 0.0])
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id long, ref string")
    assert validation.repeats(rows, ["id"], [F.col("ref")]).count() == 1
    assert validation.broken_references(rows, "ref", spark.createDataFrame([("x",)], "k string"), "k").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n01,"two\nlines ""q"""\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("01", 'two\nlines "q"')]
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n long").collect()


def test_blake2b_places_by_the_first_bytes(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id int, t array<string>")
    got = {r[0]: r[1] for r in rows.select("id", embedding.blake2b(F.col("t"), 8)).collect()}
    want = [0.0] * 8
    for term in ("a", "b", "a"):
        digest = hashlib.blake2b(term.encode(), digest_size=8).digest()
        want[int.from_bytes(digest[:4], "big") % 8] += (-1) ** digest[4]
    norm = math.sqrt(sum(x * x for x in want))
    assert got[1] == pytest.approx([x / norm for x in want])
    assert got[2] == got[3] == [0.0] * 8


def test_typed_values_that_do_not_parse_are_null(spark):
    rows = spark.createDataFrame([("12", " YES ", "a; ;b"), ("x", "0", ""), (None, "maybe", None)], "n string, b string, l string")
    got = [tuple(r) for r in rows.select(typed.integer(F.col("n")), typed.boolean(F.col("b")), typed.listed(F.col("l"))).collect()]
    assert got == [(12, True, ["a", "b"]), (None, False, []), (None, None, [])]


def test_sections_continue_and_drop_what_comes_before(spark):
    rows = spark.createDataFrame([("lost\nName: a\nb: c\nMain area: d",), (None,), ("",)], "t string")
    got = rows.select(text.sections(F.col("t")).alias("s")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [("Name", "a b: c"), ("Main area", "d")] and got[1]["s"] is None and got[2]["s"] == []


def test_expand_returns_a_seed_by_going_back_and_prefers_the_first_seed(spark):
    edges = spark.createDataFrame([("a", "r", "m"), ("b", "r", "m"), ("m", "r", "z")], "src string, rel string, dst string")
    got = {r["id"]: (r["hops"], r["seed"], r["path"]) for r in graph.expand(graph.steps_of(edges), spark.createDataFrame([("b", 1), ("a", 2)], "id string, seed_rank int")).collect()}
    assert got["m"] == (1, "b", "b -r-> m") and got["z"] == (2, "b", "b -r-> m -r-> z") and got["b"][0] == 2


def test_unknown_requirements_raise_and_the_fallback_comes_alone(spark):
    rows = spark.createDataFrame([(1, 0, 0.2), (2, 3, 0.7)], "query int, n int, top double")
    got = {(r["query"], r["rule"], r["priority"]) for r in scoring.opportunities(rows, [("A", {"n": 1}), ("B", {"n": 9})], "NEW").collect()}
    assert got == {(1, "NEW", "LOW"), (2, "A", "HIGH")}
    with pytest.raises(ValueError, match="ghost"):
        scoring.opportunities(rows, [("A", {"ghost": 1})], "NEW")


def test_stream_embeds_only_new_texts(spark, tmp_path):
    place = str(tmp_path / "vectors")
    embed = lambda rows: rows.withColumn("vector", F.array(F.length("text").cast("double")))
    for batch in ([("1", "x"), ("2", None), ("1", "x")], [("1", "x"), ("2", "new")]):
        spark.createDataFrame(batch, "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in"))
        follow(stream, embed, place, str(tmp_path / "marks")).awaitTermination(120)
    got = sorted((r["id"], r["text"] or "") for r in spark.read.parquet(place).collect())
    assert got == [("1", "x"), ("2", ""), ("2", "new")]


def test_blank_references_are_none(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "  "), (3, ""), (4, None), (5, "ghost")], "id long, ref string")
    assert [r["id"] for r in validation.broken_references(rows, "ref", spark.createDataFrame([("x",)], "k string"), "k").collect()] == [5]


def test_missed_labels_cost_ndcg_and_hits(spark):
    chosen = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query int, id long, place int")
    labels = spark.createDataFrame([(1, 7, 1), (1, 20, 2), (1, 21, 2), (2, 7, 1)], "query int, id long, grade int")
    assert scoring.ndcg(chosen, labels, 5).first()["ndcg"] == pytest.approx(1 / (3 + 3 / math.log2(3)))
    found = {r["query"]: r for r in scoring.hit_rate(chosen, labels, 2).collect()}
    assert (found[1]["hits"], found[1]["expected"], found[2]["hits"]) == (1, 3, 0) and found[1]["ceiling"] == pytest.approx(2 / 3)


def test_redundancy_compares_counts_of_one_kind(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.9, 1), (1, 2, "a", 0.89, 2), (1, 3, "b", 0.88, 3), (1, 4, "a", 0.5, 4)], "query int, id long, kind string, total double, rank int")
    terms = {1: {"x": 2, "y": 2}, 2: {"x": 2, "y": 2}, 3: {"x": 2, "y": 2}, 4: {"x": 2, "y": 1}}  # 4 shares all words with 1, at a cosine of 0.949
    counts = spark.createDataFrame([(i, t, n) for i, c in terms.items() for t, n in c.items()], "id long, term string, tf long")
    got = {r["id"]: (r["redundancy"], r["rank"]) for r in scoring.redundancy(rows, counts).collect()}
    assert got == {1: (0.0, 1), 2: (0.06, 3), 3: (0.0, 2), 4: (0.06, 4)}
    apart = counts.filter("id <> 4").unionByName(spark.createDataFrame([(4, "x", 5), (4, "y", 1)], counts.schema))  # 0.832
    assert {r["id"]: r["redundancy"] for r in scoring.redundancy(rows, apart).collect()}[4] == 0.0


def test_penalties_are_scaled_together(spark):
    row = spark.createDataFrame([(True, 0.1, 0.2, 0, 0.0, 0.0, True), (False, 0.9, 0.2, 2, 0.0, 0.5, True), (False, 0.9, 0.3, 1, 0.6, 0.0, False)], "i boolean, e double, m double, n int, p double, d double, a boolean")
    parts = scoring.penalties(*[F.col(c) for c in "iemnpda"])
    got = [tuple(r) for r in row.select(*parts.values()).collect()]
    scale = 0.35 / 0.43
    assert got[0] == pytest.approx([round(x * scale, 4) for x in (0.15, 0.10, 0.08, 0.10)])
    assert got[1] == (0, 0, 0, 0) and got[2] == (0, 0, 0, 0)


def test_confidence_of_an_empty_response_is_none(spark):
    row = spark.createDataFrame([(None, None), (0.9, 0.8), (0.9, 0.6), (0.4, 0.9)], "m double, t double")
    assert [r[0] for r in row.select(scoring.confidence(F.col("m"), F.col("t"))).collect()] == ["none", "high", "medium", "low"]


def test_synonyms_fire_by_word_and_by_phrase(spark):
    row = spark.createDataFrame([(["a", "idiot"],), (["new", "york", "zz"],), (["z"],), ([],)], "t array<string>")
    groups = (("idiot", "moron"), ("big apple", "new x"))
    got = [r[0] for r in row.select(retrieval.expanded(F.col("t"), groups)).collect()]
    assert got == [["a", "idiot", "moron"], ["new", "york", "zz"], ["z"], []]
    row = spark.createDataFrame([(["x", "new"],)], "t array<string>")
    assert row.select(retrieval.expanded(F.col("t"), groups)).first()[0] == ["x", "new", "apple", "big", "big apple", "new x"]


def test_bad_identifiers_and_relationships_raise():
    assert validation.identifier(" a ") == "a" and validation.relationship_types(["A_1", "B", "A_1"]) == ["A_1", "B"]
    for bad in (lambda: validation.identifier("  "), lambda: validation.identifier(None), lambda: validation.relationship_types("AB"), lambda: validation.relationship_types(["a-b"])):
        with pytest.raises(ValueError):
            bad()


def test_facts_are_given_once_a_record_and_subgraphs_are_closed(spark):
    edges = spark.createDataFrame([("a", "R", "b", "f", 2, "x"), ("a", "R", "b", "f", 2, "x"), ("c", "R", "a", "f", 3, "x"), ("b", "R", "z", "f", 4, "x")], "src string, rel string, dst string, source string, row long, field string")
    chosen = spark.createDataFrame([(1, 1, "a"), (1, 2, "q")], "query int, id long, node string")
    found = evidence.facts(chosen, edges)
    assert sorted((r["direction"], r["other"], r["fact"]) for r in found.collect()) == [("INCOMING", "c", "f:3:x"), ("OUTGOING", "b", "f:2:x")]
    r = evidence.coverage(chosen, found).first()
    assert (r["selected"], r["with_facts"], r["coverage"], r["all_traceable"]) == (2, 1, 0.5, False)
    rows = spark.createDataFrame([(1, "a", 1, "SIM", ["a", "b"]), (1, "q", 2, "SIM", None)], "query int, node string, rank int, relation string, bridge array<string>")
    got = evidence.subgraph(rows, spark.createDataFrame([(1, "s")], "query int, source string"), edges, 3)
    assert sorted((r["src"], r["dst"], r["origin"]) for r in got.collect()) == [("s", "a", "INFERRED"), ("s", "q", "INFERRED")]


def test_index_is_kept_until_a_file_changes(spark, tmp_path):
    path = str(tmp_path / "docs")
    schema = "id long, kind string, text string"
    spark.createDataFrame([(1, "a", "some words here"), (2, "a", None)], schema).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    one = index.index_of(read())
    assert index.index_of(read()) is one and one.n == 2 and one.average == 2.0
    asked = spark.createDataFrame([(1, "words"), (1, "absent")], "query int, term string")
    assert [(r["id"], r["df"]) for r in index.asked_postings(one, asked).collect()] == [(1, 1)]
    plan = index.asked_postings(one, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    spark.createDataFrame([(3, "b", "more")], schema).write.mode("append").parquet(path)
    assert index.index_of(read()).n == 3


def test_scores_add_up_and_ranks_descend(spark):
    from tessera.plans import search

    rows = search.scored(spark, DATA).collect()
    assert abs(sum(search.WEIGHTS.values()) - 1) < 1e-9 and rows
    for r in rows:
        assert all(-1e-9 <= r[s] <= 1 + 1e-9 for s in search.WEIGHTS)
        base = sum(w * r[s] for s, w in search.WEIGHTS.items())
        assert r["total"] == pytest.approx(max(0.0, round(max(0.0, min(1.0, base - r["penalty"])), 6) - r["redundancy"]), abs=2e-6)
    for q in {r["query"] for r in rows}:
        mine = sorted((r for r in rows if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and all(a["total"] >= b["total"] for a, b in zip(mine, mine[1:], strict=False))
        assert {c for r in mine for c in r["channels"].split("+")} == {"graph", "lexical", "vector"}


def orders_of(spark, tmp_path, rows):
    """Tables of one kind each, with these orders (o_orderkey, o_custkey)."""
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").withColumn("o_orderstatus", F.lit("O")).write.parquet(str(tmp_path / "orders.parquet"))
    for name, schema in (("customer", "c_custkey long, c_name string"), ("supplier", "s_suppkey long, s_name string"), ("region", "r_regionkey long, r_name string"), ("nation", "n_nationkey long, n_name string")):
        spark.createDataFrame([(1, "x")], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(99123, "x"), (7, "y")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def by_sql(d, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet/*.parquet'")
    return sorted(con.sql(catalog.ORACLE_SQL[name]).fetchall())


def test_identifiers_of_customers_beyond_five_digits_match_sql(spark, tmp_path):
    d = orders_of(spark, tmp_path, [(1, 7), (2, 99999), (3, 100000), (4, 899999), (5, None), (8999999, 123456)])
    assert sorted(tuple(r) for r in catalog.QUERIES["canonical_ids"](spark, d).collect()) == by_sql(d, "canonical_ids")


def test_cited_parts_are_unknown_though_parts_of_their_numbers_exist(spark, tmp_path):
    d = orders_of(spark, tmp_path, [(123, 1), (1123, 1), (5, 1), (7, 123456)])
    got = sorted(tuple(r) for r in catalog.QUERIES["guard_unknown_ids"](spark, d).select("o_orderkey", "unknown").collect())
    assert got == by_sql(d, "guard_unknown_ids") and got[2] == (123, "PT-99123")


TEXTS = [(1, "a", "the cat and the cat sat"), (2, "b", None), (3, "a", "Ünï cat, the cat"), (4, None, "it is"), (5, "b", "the cat"), (6, None, "cat the cat")]


def test_postings_are_counted_by_the_task_that_reads_the_texts(spark, tmp_path):
    rows = lambda df: sorted(map(tuple, df.select("id", "kind", "len", "term", "tf").collect()), key=str)
    more = [*TEXTS, (1, "a", "cat the dog and the cat"), (1, "b", "sat"), (7, "a", "cat the"), (7, "a", "the cat")]
    for name, texts in (("once", TEXTS), ("repeated", more)):
        path = str(tmp_path / name)
        spark.createDataFrame(texts, "id long, kind string, text string").write.parquet(path)
        docs = spark.read.parquet(path)
        own = index.index_of(docs)
        assert rows(own.postings) == rows(index.postings(docs))
        assert {r["bucket"] for r in own.postings.withColumn("same", F.col("bucket") == index.bucket(F.col("term"))).filter("same").collect()} == {r["bucket"] for r in own.blocks.collect()}
        norms = {r["id"]: r["n"] for r in index.postings(docs).groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n")).collect()}
        assert {r["id"]: r["norm"] for r in own.documents.collect()} == {i: norms.get(i, 0.0) for i, _, _ in texts}
    assert "Exchange" not in counts.blocks(docs, False)._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_few_bytes_give_the_same_postings(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "id long, kind string, text string").coalesce(1)
    batch = counts.counted(docs, False).toArrow().combine_chunks().to_batches()[0]
    parts = [batch.slice(i, 1) for i in range(len(TEXTS))]
    assert [t.num_rows for t in counts.chunks(iter(parts), ("tokens",))] == [len(TEXTS)]
    monkeypatch.setattr(counts, "CHUNK", 1)
    assert [t.num_rows for t in counts.chunks(iter(parts), ("tokens",))] == [1] * len(TEXTS)
    one = counts.count(counts.whole(next(counts.chunks(iter(parts), ("tokens",))), "tokens"))
    assert one.terms.to_pylist() == ["and", "cat", "sat", "the", "and the", "cat and", "cat sat", "the cat"] and one.tf.tolist() == [1, 2, 1, 2, 1, 1, 1, 2]


@pytest.mark.parametrize("name", ["term_statistics", "bigram_stats", "hash_embedding_md5", "counter_cosine"])
def test_term_queries_match_sql_on_odd_texts_with_one_shuffle_at_most(spark, tmp_path, name):
    more = [*TEXTS, (1, "a", "cat the dog and the cat"), (1, "b", "sat"), (7, "a", "cat the"), (7, "a", "the cat")]
    for part, texts in (("once", TEXTS), ("repeated", more)):
        path = str(tmp_path / part / "documents.parquet")
        spark.createDataFrame([(i, k, "s", t) for i, k, t in texts], "doc_id long, lang string, source string, text string").write.parquet(path)
        got, con = catalog.QUERIES[name](spark, str(tmp_path / part)), duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        columns = sorted(got.columns)
        want = con.sql(catalog.ORACLE_SQL[name]).select(*(f'"{c}"' for c in columns)).fetchall()
        assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)
        if part == "once":
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning") <= plan.count("MapInArrow")


def test_blake2b_query_hashes_chunks_of_bounded_size(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, k, "s", t) for i, k, t in [*TEXTS, (1, "a", "cat the dog")]], "doc_id long, lang string, source string, text string").write.parquet(path)
    got = catalog.QUERIES["hash_embedding_blake2b"](spark, str(tmp_path))
    tokens = spark.read.parquet(path).select("doc_id", text.tokenize(F.col("text")).alias("t"))
    plain = tokens.select("doc_id", F.posexplode(embedding.blake2b(F.concat("t", text.bigrams(F.col("t"))), 64)).alias("place", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))
    assert got.schema.simpleString() == plain.schema.simpleString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= counts.BATCH


def test_expansion_does_not_shuffle_the_steps(spark):
    edges = spark.createDataFrame([("a", "r", "m"), ("a", "r", "m"), ("m", "r", "z"), ("m", "s", "z")] + [(f"x{i}", "r", f"x{i + 1}") for i in range(50)], "src string, rel string, dst string")
    found = graph.expand(graph.steps_of(edges), spark.createDataFrame([("a", 1)], "id string, seed_rank int"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 2, "a", "a -r-> m <-r- a"), ("m", 1, "a", "a -r-> m"), ("z", 2, "a", "a -r-> m -r-> z")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
