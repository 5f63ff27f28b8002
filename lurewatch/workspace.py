"""Shared working folder and materialised tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_base: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``.

    Every executor has to reach that folder, so a session without the setting is an error, unless it is one single
    process (master ``local[...]``, as in tests), which may use a folder of its own.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local_base = _local_base or tempfile.mkdtemp(prefix="lurewatch-")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    system, where = _hadoop_path(spark, path)
    return bool(system.exists(where))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this package has written to the shared folder."""
    system, where = _hadoop_path(spark, path)
    system.delete(where, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors.

    The table stays until ``release`` gets it; a loop releases each round's tables when the next is written.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)
