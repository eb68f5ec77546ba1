"""The engine object and its command line on the smallest tables."""

import json
import os

import pytest

from tessera.__main__ import main
from tessera.engine import Engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_search_fills_quotas_first_and_ranks(spark):
    rows = Engine(spark, DATA).search("the thing pour les dans", ("en", "fr"), 6).orderBy("place").collect()
    assert len(rows) == 6 and {r["kind"] for r in rows[:4]} == {"en", "fr"} and all(r["terms"] for r in rows)
    assert [r["rank"] for r in rows[4:]] == sorted(r["rank"] for r in rows[4:])


def test_bad_requests_raise(spark):
    engine = Engine(spark, DATA)
    for bad in (lambda: engine.search(" "), lambda: engine.search("x", limit=51), lambda: engine.entity("Ghost", "GH-1")):
        with pytest.raises(ValueError):
            bad()


def test_entity_guard_expand_and_checks(spark, tmp_path):
    engine = Engine(spark, DATA)
    one = engine.entity("Nation", "NT-3").collect()
    assert len(one) == 1 and one[0]["degree"] >= 1 and not engine.entity("Nation", "NT-99").collect()
    assert [r[0] for r in engine.guard("NT-10 borders NT-98 and NT-98").collect()] == ["NT-98"]
    assert engine.expand(["SU-4", "SU-4"]).filter("seed <> 'SU-4'").isEmpty()
    assert engine.validate().isEmpty()
    assert {r["name"]: r["n"] for r in engine.health().collect()}["Nation"] == 25
    engine.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == engine.nodes.count()


def test_command_line_prints_json_lines(spark, capsys):
    main([DATA, "search", "the thing", "--limit", "2"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["place"] for x in sorted(lines, key=lambda x: x["place"])] == [1, 2]
