"""Sources and sinks: manifests, JSON lines, nested runs, chunk collections, indexes with versions, page files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import collapsed
from lectern.operators.chunking import build_chunks, indexable
from lectern.operators.indexes import postings_of, save_blocks
from lectern.sources.places import written

CASES = "id string, question string, ideal_answer string, expected_sources array<string>, answer_type string"
JUDGE = "correctness: int, faithfulness: int, completeness: int, citation: int, evidence_relevance: int, overall: int, error_type: string, reason: string"
RUN = f"run_id string, timestamp string, results array<struct<qid: string, question: string, model_answer: string, judge: struct<{JUDGE}>, error: string>>"
MIN_PAGE_CHARS = 50


class StaleIndex(RuntimeError):
    """An index was built from another version of its chunks."""


def paper_meta(spark: SparkSession, path: str) -> DataFrame:
    """key, title, doi: a row for each file name and each stem of a manifest; blank keys are left out; no file, no rows."""
    try:
        rows = spark.read.csv(path, header=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "key string, title string, doi string")
    stem = F.regexp_replace("final_file", r"\.[^.]*$", "")
    rows = rows.filter(F.trim(F.coalesce("final_file", F.lit(""))) != "")
    return rows.select(F.explode(F.array_distinct(F.array("final_file", stem))).alias("key"), "title", "doi")


def json_lines(spark: SparkSession, path: str, schema: str = CASES, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on a bad line, lenient reading leaves it out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("_bad", F.col("_corrupt_record").isNotNull()).filter("not _bad").drop("_bad", "_corrupt_record")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Nested run files of a directory; files that don't parse are left out."""
    rows = spark.read.schema(f"{RUN}, _corrupt_record string").option("multiLine", True).json(path)
    return rows.filter("run_id is not null").drop("_corrupt_record")


def run_results(nested: DataFrame) -> DataFrame:
    return nested.select("run_id", "timestamp", F.explode("results").alias("r")).select("run_id", "timestamp", "r.*")


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """paper_id, source, page, text, error of the binary files below ``path``; ``parse`` gives a file's pages, in which a null is
    a page that can't be read. A file that can't be read is a row with its error and no page; so is a file without pages.
    Spark's reader passes over files without a byte."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                file = name.rsplit("/", 1)[-1]
                paper = file.rsplit(".", 1)[0]
                try:
                    texts = parse(bytes(content))
                    failed = None if texts else "no pages"
                except Exception as error:  # noqa: BLE001  a file that can't be read is reported, the others go on
                    texts, failed = [], f"{type(error).__name__}: {error}"
                if failed:
                    out.append((paper, file, None, None, failed))
                out += [(paper, file, i, t, None if t is not None else "unreadable page") for i, t in enumerate(texts, 1)]
            frame = pd.DataFrame(out, columns=["paper_id", "source", "page", "text", "error"])
            yield frame.astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.dropDuplicates(["path"]).mapInPandas(pages, "paper_id string, source string, page int, text string, error string")


def page_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], least: int = MIN_PAGE_CHARS, keep_lines: bool = False) -> DataFrame:
    """paper_id, source, page, text of what ``read_pages`` can read; without ``keep_lines`` white space is collapsed and short pages go."""
    rows = read_pages(spark, path, parse).filter("error is null").drop("error")
    return rows if keep_lines else rows.withColumn("text", collapsed(F.col("text"))).filter(F.length("text") >= least)


def ingested(pages: DataFrame, path: str, mode: str = "section_aware", **sizes: int) -> dict[str, int]:
    """Cut pages into chunks, write those that may be indexed as a new collection, and count in the same pass.

    pages (read), chunks (cut), excluded (of sections that aren't indexed), fallbacks (cut without headings) and indexed.
    """
    seen, cut = Observation("pages"), Observation("chunks")
    # sections read their lines more than once: the pages are counted where each is read first
    chunks = build_chunks(written(pages.observe(seen, F.count("*").alias("pages")), "pages"), mode, **sizes)
    section = F.col("section") if "section" in chunks.columns else F.lit("")
    plain = F.col("chunking_mode") == "fallback_fixed" if "chunking_mode" in chunks.columns else F.lit(False)
    counts = {"chunks": F.count("*"), "excluded": F.count_if(~indexable(section)), "fallbacks": F.count_if(plain), "indexed": F.count_if(indexable(section))}
    chunks = chunks.observe(cut, *(x.alias(name) for name, x in counts.items()))
    write_collection(chunks.filter(indexable(section)), path)
    return seen.get | cut.get


def write_collection(chunks: DataFrame, path: str) -> None:
    """A new collection; one that is there already is never overwritten."""
    chunks.write.mode("errorifexists").parquet(path)


def collection_count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return 0


def collection_version(chunks: DataFrame) -> str:
    """A hash of what the collection holds, whatever the order of its rows."""
    sums = chunks.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(i), "chunk_id", "text").cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2))).first()
    return "-".join(str(x or 0) for x in sums)


def save_index(index: DataFrame, path: str, version: str, chunk_count: int) -> None:
    """Posting blocks by shard and token, with the highest weight of each, and a manifest of the chunks they were built from."""
    save_blocks(index, f"{path}/blocks")
    manifest = index.sparkSession.createDataFrame([(version, chunk_count, index.count())], "collection_version string, chunk_count long, posting_count long")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def open_blocks(spark: SparkSession, path: str, version: str, chunk_count: int) -> DataFrame:
    """The saved blocks, for ``block_search``; an index of another collection is an error."""
    manifest = spark.read.schema("collection_version string, chunk_count long, posting_count long").json(f"{path}/manifest").first()
    if manifest is None or (manifest.collection_version, manifest.chunk_count) != (version, chunk_count):
        raise StaleIndex(f"{path} was built from {manifest}, the collection is {version} with {chunk_count} chunks")
    return spark.read.parquet(f"{path}/blocks")


def load_index(spark: SparkSession, path: str, version: str, chunk_count: int) -> DataFrame:
    """The saved postings: token, id, weight."""
    return postings_of(open_blocks(spark, path, version, chunk_count))
