"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    All of an application's folders lie in one, which the driver deletes when it ends. Where the setting is missing, a local
    session gets a temporary folder and any other raises, for executors elsewhere would not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: later jobs neither recompute nor lose them."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every table this application has saved; frames that still read one fail from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
