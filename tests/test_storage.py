"""Saved tables live in one folder of the application and can be cleared."""

import os

from tessera import storage


def test_saved_tables_come_back_and_are_cleared(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = storage.save(spark.range(3))
    assert sorted(r[0] for r in before.collect()) == [0, 1, 2]
    own = storage.scratch(spark)
    assert own.startswith(f"{base}/tessera-{spark.sparkContext.applicationId}/")
    assert len(os.listdir(os.path.dirname(own))) >= 1


def test_a_cluster_without_a_shared_folder_raises():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    try:
        storage.scratch(Session())
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("no error")
