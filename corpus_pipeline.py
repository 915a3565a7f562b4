"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's ``docs``. All but the last return the columns of documents; the last returns the pieces
of all documents with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boilerplate, minhash, mixing, packing, quality
from lectern.llm.shared import once, read, stored, with_keys


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts fail the rules; very long texts are judged whole; repeated rows are judged alike, so there are no
    ties; an empty table stays empty; columns stay as they are, whatever they're called.
    """
    return quality.good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; so does a document that loses all lines that held a word.

    Null and empty texts lose nothing and stay; very long texts lose lines like any; of repeated rows and ties the line's
    first occurrence (smallest doc_id, text hash, line number) stays, in each of several equal rows; an empty table stays
    empty; columns but text and n_chars stay as they are, whatever they're called.
    """
    rows = boilerplate.deduplicated(docs)
    empty = (F.col("_n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.filter(~empty).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once.

    Shingles have five words. Null, empty and wordless texts stay, as they're like nothing; very long texts are compared
    whole; a null doc_id is the smallest; of repeated rows and ties of doc_id the one with the smaller text hash stays;
    groups are told apart by their roots, as unlike texts can share a doc_id, or have none; an empty table stays empty;
    columns stay as they are, whatever they're called.
    """
    found = stored(minhash.near_duplicates(docs, length=5).select("_d", "_k", "n", "root"), "found")
    groups = found.groupBy("root", "_d", "_k", "n").agg(F.count("*").alias("m")).filter("n > 0")
    kept = groups.groupBy("root").agg(F.min(F.struct("_d", "_k", "m")).alias("_least")).select("_least._d", "_least._k", "_least.m")
    kept = stored(kept, "kept")
    words = F.coalesce(F.col("_row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = with_keys(docs)
    heads = once(rows.filter(words), kept.select("_d", "_k"), kept.filter("m > 1").select("_d", "_k"))
    rows = heads.select("_row").unionByName(rows.filter(~words).select("_row"))
    return rows.select(*(F.col(f"_row.`{x}`").alias(x) for x in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source cut at its budget.

    Null, empty and wordless texts aren't taken; a very long text counts with all its words and may be the one that is cut;
    repeated rows count each; ties of keys go to the smaller doc_id, then text hash; an empty table stays empty; columns
    but text and n_chars stay as they are, whatever they're called.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    Null and empty texts are their end id alone; very long texts are cut into pieces; repeated rows and ties are packed
    each by itself; an empty table gives no rows; other columns are left out.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack", pack),
]

#: Neither the field behind the first stage nor the packing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
