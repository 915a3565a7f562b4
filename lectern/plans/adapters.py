"""How the supplied tables stand in for the engine's inputs: the same small definitions in Spark and in DuckDB.

The supplied texts hold no headings, citations or metrics, so these are put in, by fixed rules on ids and line numbers.
Each Spark adapter has its SQL twin: a list of common table expressions for the oracles.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.places import spread

HEADINGS = (
    "Abstract", "1. Introduction", "2 Materials and Methods", "3.1 Adsorption experiments", "12. Smith, J. A. et al. 2020", "Results and discussion",
    "4.2) The effect of pH", "CONCLUSIONS:", "References", "5. Therefore we stop", "Acknowledgements",
)
RUNNING = "Journal of Lines,  Volume 7"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, i (from 0), line of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three lines."""
    rows = lines(spark, sf_dir).withColumn("page", F.floor(F.col("i") / 3).cast("int") + 1)
    pages = rows.groupBy("doc_id", "source", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), "source", "page", "text")


def headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a heading before every fourth one, but in every fifth document, a running header on each page, a page number."""
    pick = F.element_at(F.array(*map(F.lit, HEADINGS)), ((F.col("doc_id") + F.col("i")) % len(HEADINGS) + 1).cast("int"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("i") % 3 == 0, F.lit(RUNNING)),
            F.when((F.col("i") % 4 == 0) & (F.col("doc_id") % 5 != 0), pick),
            F.col("line"),
            F.when(F.col("i") % 3 == 2, F.col("i").cast("string")),
        )
    )
    return lines(spark, sf_dir).select("doc_id", "source", "i", F.array_join(parts, "\n").alias("line"))


def headed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headed_lines(spark, sf_dir).withColumn("page", F.floor(F.col("i") / 3).cast("int") + 1)
    pages = rows.groupBy("doc_id", "source", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), "source", "page", "text")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def decomposed_sql(c: str) -> str:
    """SQL: a text whose Latin letters and forms of digits beyond ASCII stand decomposed, with blanks for marks.

    Enough where only ASCII letters and digits count afterwards: one letter and its marks by ``translate`` and a blank behind
    it, ligatures and fractions one by one.
    """
    marked, single, others = {}, {}, {}
    for i in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)):
        image = "".join(y if y.isascii() and y.isalnum() else " " for y in unicodedata.normalize("NFKD", chr(i)))
        if not image.isspace() and image != chr(i):
            (single if len(image) == 1 else marked if not image[1:].strip() else others)[chr(i)] = image
    spaced = f"regexp_replace({c}, '([{''.join(marked)}])', '\\1 ', 'g')"
    flat = f"translate({spaced}, {q(''.join(marked) + ''.join(single))}, {q(''.join(x[0] for x in marked.values()) + ''.join(single.values()))})"
    for x, image in others.items():
        flat = f"replace({flat}, {q(x)}, {q(image)})"
    return flat


def sql_list(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


LINES_SQL = """
raw AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM raw)
"""
PLAIN_PAGES_SQL = (
    LINES_SQL
    + """,
pages_in AS (SELECT 'd' || doc_id AS paper_id, source, (i // 3 + 1)::INT AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id, source, i // 3)
"""
)
HEADED_PAGES_SQL = (
    LINES_SQL
    + f""",
headed AS (SELECT doc_id, source, i, concat_ws(chr(10), CASE WHEN i % 3 = 0 THEN {q(RUNNING)} END,
    CASE WHEN i % 4 = 0 AND doc_id % 5 <> 0 THEN {sql_list(HEADINGS)}[(doc_id + i) % {len(HEADINGS)} + 1] END, line, CASE WHEN i % 3 = 2 THEN i::VARCHAR END) AS line FROM lines),
pages_in AS (SELECT 'd' || doc_id AS paper_id, source, (i // 3 + 1)::INT AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM headed GROUP BY doc_id, source, i // 3)
"""
)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return q(x)


def values_sql(name: str, rows: list[tuple], schema: str) -> str:
    columns = [x.split()[0] for x in schema.split(", ")]
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"
