"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL = "file:///tmp/checkpoints/lectern"


def shared_place(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; a local one only in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("no folder is shared by driver and executors: set spark.checkpoint.dir")
        found = LOCAL
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_place(spark: SparkSession, name: str) -> str:
    return f"{shared_place(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to the shared folder, computed once: lineage ends there."""
    path = fresh_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; Spark keeps them until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(table: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt over all cores: a small file of one row group is one task.

    Such a table has fewer splits than the session has cores, so what moves is bounded by them; larger ones stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
