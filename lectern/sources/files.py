"""Files: discovery over several folders, archives of files, CSV pairs and views, runs that go on where they stopped."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.metrics import eval_judge
from lectern.sources.places import written
from lectern.sources.tables import page_files

#: Bytes of a file in memory at once while it's copied.
COPIED = 1 << 20


def discovered(spark: SparkSession, folders: dict[str, tuple[str, bool]], suffix: str = ".pdf") -> DataFrame:
    """path, source_group, length of the files below some folders, each path once, whatever its case, in its first group.

    ``folders``: group to (folder, whether its folders are looked into); a folder that isn't there holds nothing.
    """
    out = spark.createDataFrame([], "path string, source_group string, length long, place int")
    for place, (group, (folder, deep)) in enumerate(folders.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", f"*{suffix}")
        try:
            rows = files.load(folder)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = out.unionByName(rows.select("path", F.lit(group).alias("source_group"), "length", F.lit(place).alias("place")))
    first = out.groupBy(F.lower("path").alias("key")).agg(F.min(F.struct("place", "path", "source_group", "length")).alias("one"))
    return first.select("one.path", "one.source_group", "one.length")


def zip_members(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """archive, name, content of the members of archives, by their bare names; an archive that can't be read has none."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        rows = [(name.rsplit("/", 1)[-1], x.filename.rsplit("/", 1)[-1], archive.read(x)) for x in archive.infolist() if x.filename.lower().endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(members, "archive string, name string, content binary")


def pages_for(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], mode: str) -> DataFrame:
    """Pages as a chunking mode needs them: with their lines for sections, else collapsed and without short ones."""
    return page_files(spark, path, parse, keep_lines=mode == "section_aware")


def placed(files: DataFrame, target: str) -> DataFrame:
    """Copy files (path, folder, file) to ``target``/folder/file and return path, place and length of each copy.

    Tasks copy in streams, each file under a name of its own first and then, whole, under its last name, in a folder beside
    the last one; the driver renames that once all tasks are done. So a task that's repeated, or a run that's stopped,
    leaves no half file in ``target``, and nothing at its source is touched. A target that is there is an error.
    """
    spark = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    last, beside = hadoop.Path(target), hadoop.Path(f"{target.rstrip('/')}-{uuid.uuid4().hex}")
    system = last.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(last):
        raise FileExistsError(target)
    root = system.makeQualified(beside).toString()

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, folder, file in zip(batch["path"], batch["folder"], batch["file"], strict=True):
                source, there = _opened(path)
                goal, base = _opened(f"{root}/{folder}")
                goal.create_dir(base, recursive=True)
                part = f"{base}/.{uuid.uuid4().hex}"
                with source.open_input_stream(there) as left, goal.open_output_stream(part) as right:
                    length = 0
                    while block := left.read(COPIED):
                        right.write(block)
                        length += len(block)
                goal.move(part, f"{base}/{file}")
                out.append((path, f"{folder}/{file}", length))
            yield pd.DataFrame(out, columns=["path", "place", "length"])

    log = written(files.select("path", "folder", "file").mapInPandas(copy, "path string, place string, length long"), "placed")
    if log.isEmpty():
        system.mkdirs(beside)
    else:
        for x in system.listStatus(beside):
            for y in system.listStatus(x.getPath()):
                if y.getPath().getName().startswith("."):  # of a task that was stopped
                    system.delete(y.getPath(), False)
    if not system.rename(beside, last):
        raise OSError(f"{beside} can't be renamed")
    return log


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the place in it; Hadoop writes file:/x where others write file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def csv_pair(spark: SparkSession, evals: str, judges: str | None = None) -> DataFrame:
    """Answers of an older CSV with the judgements of another, which may be missing; blank ids have none, the last of an id wins."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(evals).withColumnRenamed("id", "qid")
    if judges is None:
        return rows.withColumn("judge", F.lit(None).cast("struct<overall: int, error_type: string>"))
    marks = spark.read.option("header", True).option("multiLine", True).csv(judges)
    marks = marks.select(F.col("id").alias("qid"), F.col("overall").try_cast("int").alias("overall"), "error_type", F.monotonically_increasing_id().alias("seq"))
    return eval_judge(rows, marks)


def newest(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """The newest CSV below a folder, with renamed columns; names that it doesn't have are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)
    last = files.agg(F.max(F.struct("modificationTime", "path")).alias("one")).first().one
    if last is None:
        raise FileNotFoundError(f"no CSV below {path}")
    return spark.read.option("header", True).option("multiLine", True).csv(last.path).withColumnsRenamed(names)


def remaining(todo: DataFrame, *done: DataFrame) -> DataFrame:
    """The rows of ``todo`` whose DOI, whatever its case, is in none of the lists of what's done or given up."""
    rows = todo.withColumn("_doi", F.lower("doi"))
    for other in done:
        rows = rows.join(other.select(F.lower("doi").alias("_doi")).distinct(), "_doi", "left_anti")
    return rows.drop("_doi")


def resumed(todo: DataFrame, path: str, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, batch: int = 20) -> DataFrame:
    """Do ``work`` on the rows of ``todo`` and return all results below ``path``: a run that's stopped loses one batch at most.

    The rows are listed in files of ``batch`` rows below ``path``, and a checkpointed stream takes as many of these at once
    as there are cores. Each batch of the stream writes its results to a folder of its number, which a repeated batch
    replaces, so that no row is lost or done twice, nulls and repeated rows included. Rows of ``todo`` that are listed
    already aren't listed again; new ones are, as often as they're missing.
    """
    spark = todo.sparkSession
    try:
        listed = spark.read.schema(todo.schema).parquet(f"{path}/todo")
        new = todo.exceptAll(listed)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new = todo
    new.write.mode("append").option("maxRecordsPerFile", batch).parquet(f"{path}/todo")

    def keep(rows: DataFrame, number: int) -> None:
        rows.mapInPandas(work, schema).write.mode("overwrite").parquet(f"{path}/done/batch={number}")

    files = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(f"{path}/todo")
    run = files.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return results(spark, path, schema)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``resumed`` has kept so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/done")
