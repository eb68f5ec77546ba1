"""The registered queries and the pipeline as a whole on the smallest tables: against SQL, or against plain versions."""

import hashlib
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import packing, registry, simhash

DATA = "/root/testdata/sf0.001"
TABLES = [p.removesuffix(".parquet") for p in os.listdir(DATA) if p.endswith(".parquet")] if os.path.isdir(DATA) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


def cell(x):
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(cell(x) for x in r) for r in found), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_languages_of_all_pages_and_documents(spark, con, texts):
    rows = registry.QUERIES["op2_language"](spark, DATA).collect()
    told = dict(con.sql("SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) FROM pages").fetchall())
    assert sorted(r["page_id"] for r in rows) == sorted(told)
    assert sum(r["language"] == told[r["page_id"]] for r in rows) >= 0.9 * len(rows)
    rows = registry.QUERIES["language_of_documents"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and sum(r["language"] == r["declared"] for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("name,longest,most,cost", [("op4_pack", 2048, 10**9, 10**18), ("packed_in_limits", 1773, packing.TIGHT.documents, packing.TIGHT.attention)])
def test_packing_keeps_its_limits(spark, texts, name, longest, most, cost):
    by, seqs = {}, {}
    for r in registry.QUERIES[name](spark, DATA).collect():
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for pieces in by.values():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == longest for _, _, n in pieces[1:])
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:i]) for i in range(len(pieces))]
    for content in seqs.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))]
        assert sum(n for _, n in content) <= 2048 and len(content) <= most and sum(n * n for _, n in content) <= cost


@pytest.mark.parametrize("name,label,held", [("op5_toxicity", "toxic", lambda c: c % 4 == 2), ("op7_pu_quality", "quality", lambda c: c % 5 == 0)])
def test_scores_of_all_documents(spark, con, texts, name, label, held):
    rows = {r["doc_id"]: r for r in registry.QUERIES[name](spark, DATA).collect()}
    assert set(rows) == set(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(zlib.crc32(str(i).encode())) for i, r in rows.items())
    known = con.sql(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall()
    clean = [rows[i]["predicted"] for i, x in known if x == (1 if label == "quality" else 0)]
    assert sum(clean) / len(clean) >= 0.9 if label == "quality" else sum(clean) / len(clean) <= 0.1


def test_fingerprints_and_shards_of_all_documents(spark, texts):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op6_simhash"](spark, DATA).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == {i: simhash.fingerprint(t.encode(), 3)[0] % (1 << 64) for i, t in texts.items()}
    rows = {r["doc_id"]: r for r in registry.QUERIES["op8_ctph"](spark, DATA).collect()}
    order = sorted(texts, reverse=True)
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        k = len(text) // 3
        assert rows[doc]["n_chars"] == len(text) and rows[doc]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
    rows = registry.QUERIES["op9_interleaved_shards"](spark, DATA).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_pipeline_keeps_columns_and_packs_what_stays(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        from tessera.llm.common import save

        docs = save(stage(spark, docs, DATA))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == columns
    assert kept[0] <= set(texts) and kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[4] == kept[3]
    assert len(kept[0]) >= 0.95 * len(texts) and len({texts[i] for i in kept[2]}) == len(kept[2])  # no text stays twice
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == len(kept[4])
