"""Intermediate tables in the folder that driver and executors share.

Expensive or non-deterministic intermediates are written as Parquet under
``spark.checkpoint.dir`` and read back, which cuts lineage and lets any
executor be lost later without recomputation of what came before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; a local one is made only for local masters."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loomfold-")
    spark.conf.set(SETTING, root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._loom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for table in tables:
        if path := getattr(table, "_loom_path", None):
            discard_path(table.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
