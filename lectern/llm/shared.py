"""What the operators of this subpackage share: places to write, row keys, the word pattern."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.places import spread

#: A word: a run of anything but ASCII blanks, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Where intermediate tables go when a local session names no shared folder, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/lectern"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session, whose executors are the driver, may do with a local one; elsewhere a missing folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("no folder is shared by driver and executors: set spark.checkpoint.dir")
        found = LOCAL_DIR
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was made of them is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def with_keys(docs: DataFrame) -> DataFrame:
    """``_d`` and ``_k`` as in ``keyed``, and ``_row``: the whole row, so that no column name can clash."""
    return keyed(docs, F.struct("*").alias("_row")).drop("text")


def keyed(docs: DataFrame, *extra) -> DataFrame:
    """``_d`` (doc_id; null as the least long), ``_k`` (hash of id and text), ``text`` and what else is named.

    Together they tell apart rows of one doc_id with different texts; rows equal in both are interchangeable.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_k"),
        F.col("text"),
        *extra,
    )


#: Ids that ``chosen`` may broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 400_000


def matched(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``_d`` and ``_k``; a stored ``other`` is broadcast only if its files are under the session's threshold."""
    return rows.join(other, ["_d", "_k"], how)


def chosen(rows: DataFrame, ids: DataFrame, on: tuple[str, ...] = ("_d", "_k"), how: str = "inner") -> DataFrame:
    """The rows with the keys of ``ids``, a stored table of a few numbers a row, broadcast if it's counted as small."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, list(on), how)


def once(rows: DataFrame, ids: DataFrame, repeated: DataFrame) -> DataFrame:
    """One of the rows for each of ``ids``; only those of ``repeated`` (keys that several rows have) are compared.

    ``ids`` and ``repeated`` are stored tables; other rows stay where they are while ``ids`` are few.
    """
    several = stored(ids.join(repeated, ["_d", "_k"], "left_semi"), "several")
    single = stored(ids.join(repeated, ["_d", "_k"], "left_anti"), "single")
    return chosen(rows, single).unionByName(chosen(rows, several).dropDuplicates(["_d", "_k"]))


def unkeyed(d: str = "_d"):
    """The doc_id that ``keyed`` put in ``_d``."""
    return F.when(F.col(d) != F.lit(-(2**63)), F.col(d))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
