"""Files of a dataset and settings, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import settings
from tessera.operators import scoring, validation
from tessera.sources import files


def test_discovery_wants_exactly_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("TESSERA_DATA", raising=False)
    for name in ("one/a", "one/b", "two/a"):
        (tmp_path / name).mkdir(parents=True)
    one = str(tmp_path / "one")
    assert files.discover(spark, one, ("a", "b")) == one
    assert files.discover(spark, str(tmp_path), ("a", "b")).endswith("/one")
    for start, wanted in ((tmp_path, ("a",)), (tmp_path, ("c",)), (tmp_path / "absent", ("a",))):
        with pytest.raises(ValueError):
            files.discover(spark, str(start), wanted)
    monkeypatch.setenv("TESSERA_DATA", str(tmp_path / "two"))
    assert files.discover(spark, one, ("a",)).endswith("/two")
    with pytest.raises(ValueError):
        files.discover(spark, one, ("a", "b"))


def test_manifests_declare_counts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "dataset_manifest_1.json").write_text(json.dumps({"record_counts": {"a": 2, "b": 3}, "more": [1]}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    found = files.manifests(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("x/dataset_manifest_1.json", "a", 2), ("x/dataset_manifest_1.json", "b", 3)]
    actual = spark.createDataFrame([("a", 2), ("c", 1)], "name string, actual long")
    assert {r["name"]: r["status"] for r in validation.count_mismatches(actual, found.drop("file")).collect()} == {"a": "ok", "b": "missing", "c": "unmapped"}
    (tmp_path / "dataset_manifest.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.manifests(spark, str(tmp_path)).collect()


def test_markdown_is_read_whole_by_relative_path(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c+d é.md").write_text("# one\n\ntwo\n")
    (tmp_path / "e.md").write_text("")
    catalog = spark.createDataFrame([(1, "a b/c+d é.md"), (2, "e.md"), (3, "absent.md"), (4, None)], "id int, path string")
    assert {r["id"]: r["text"] for r in files.markdown(spark, catalog, f"{tmp_path}/").collect()} == {1: "# one\n\ntwo\n", 2: None, 3: None, 4: None}


def test_documents_need_ids_of_their_own(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"id": "a", "text": "x"}\n{"id": "b"}\n')
    assert files.read_documents(spark, str(path), "id string, text string").count() == 2
    for line in ('{"id": "a"}', '{"id": " "}', '{"text": "y"}'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(path.read_text() + line + "\n")
        with pytest.raises(ValueError, match="ids"):
            files.read_documents(spark, str(bad), "id string, text string")


def test_vectors_are_checked_and_made_unit_length(spark, tmp_path):
    schema = "id string, model string, dimension int, embedding array<float>"
    write = lambda rows, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    write([("a", "m", 2, [3.0, 4.0]), ("b", "m", 2, [0.0, 0.0])], "good")
    got = {r["id"]: r["embedding"] for r in files.read_vectors(spark, str(tmp_path / "good"), "m", 2).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["b"] == [0.0, 0.0]
    for model, dimension in (("n", 2), ("m", 3)):
        with pytest.raises(ValueError, match="not of"):
            files.read_vectors(spark, str(tmp_path / "good"), model, dimension)
    write([], "empty")
    assert files.read_vectors(spark, str(tmp_path / "empty"), "m", 2).count() == 0
    bad = {"models": ("b", "n", 2, [1.0, 0.0]), "sizes": ("b", "m", 3, [1.0, 0.0, 0.0]), "null": ("b", None, 2, [1.0, 0.0]), "short": ("b", "m", 2, [1.0]), "none": ("b", "m", 2, None)}
    for name, row in bad.items():
        write([("a", "m", 2, [1.0, 0.0]), row], name)
        with pytest.raises(ValueError):
            files.read_vectors(spark, str(tmp_path / name))


def test_interrupted_vectors_lose_only_cut_lines(spark, tmp_path):
    line = {"id": "a", "model": "m", "dimension": 2, "text_sha256": "h", "embedding": [1.0, 0.0]}
    path = tmp_path / "v.jsonl"
    path.write_text(json.dumps(line) + "\n" + json.dumps(line | {"id": "b"})[:40])
    assert [r["id"] for r in files.read_partial_vectors(spark, str(path), "m", 2).collect()] == ["a"]
    with pytest.raises(ValueError, match="not of"):
        files.read_partial_vectors(spark, str(path), "other", 2)


def test_manifest_of_vectors_is_written_as_json(spark, tmp_path):
    docs = spark.createDataFrame([("a", "k", "x"), ("b", "k", None), ("c", None, "z")], "id string, kind string, text string")
    have = docs.filter("id <> 'c'").select("id", F.lit("m").alias("model"), F.lit(2).alias("dimension"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    made = files.vectors_manifest(have, docs)
    assert made["total"] == 2 and made["by_kind"] == {"k": 2, "": 0} and made["warnings"] == ["1 documents without a vector of their present text"]
    assert files.vectors_manifest(have, docs.repartition(3))["source_hash"] == made["source_hash"]
    assert files.vectors_manifest(have, docs.filter("id <> 'a'"))["source_hash"] != made["source_hash"]
    files.write_json(spark, str(tmp_path / "m.json"), made | {"name": "é"})
    text = (tmp_path / "m.json").read_text("utf-8")
    assert json.loads(text) == made | {"name": "é"} and text.endswith("}\n") and "é" in text


def test_settings_overlay_profiles_and_missing_weights_are_zero(spark, tmp_path):
    (tmp_path / "ranking.json").write_text('{"version": 2, "weights": {"a": 0.6, "b": 0.4}}')
    (tmp_path / "profiles.json").write_text('{"defaults": {"x": [1, 2], "y": 1}, "kinds": {"K": {"x": [3]}}}')
    (tmp_path / "rules.json").write_text('{"rules": [{"name": "A", "requires": {"n": 1}}, {"name": "B"}]}')
    got = settings.load(tmp_path)
    assert got.version == "2" and got.weight("c") == 0.0 and got.profile("K") == {"x": [3], "y": 1} and got.profile("other") == {"x": [1, 2], "y": 1}
    row = spark.createDataFrame([(0.5, 1.0, 9.0, 1, 0.1)], "a double, b double, c double, n int, top double").withColumn("query", F.lit(1))
    assert row.select(got.base(["a", "b", "c"])).first()[0] == pytest.approx(0.7)
    assert [r["rule"] for r in scoring.opportunities(row, got.opportunity_rules(), "NEW").orderBy("number").collect()] == ["A", "B"]
    (tmp_path / "retrieval.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        settings.load(tmp_path)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no settings"):
        settings.load(tmp_path / "none")


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "ranking.yaml").write_text("version: v1\nweights:\n  a: 1\n")
    assert settings.load(tmp_path).weight("a") == 1.0
