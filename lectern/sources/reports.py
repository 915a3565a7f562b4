"""Sinks of evaluations and of the corpus: flat CSV, Markdown, run files, chunk files with statistics, dedup reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.metrics import BAD_BELOW, ERROR_TYPES

# The columns of the flat file and of the dedup reports, and the headings of the Markdown reports.
SCORES = ("correctness", "evidence_relevance", "faithfulness", "completeness", "citation", "overall")
FLAT = ("qid", "answer_type", "question", *SCORES, "error_type", "reason", "n_retrieved", "top1_source", "top1_distance", "has_error")
MANIFEST = ("final_file", "resolution", "sha256", "doi", "title", "text_length", "source_group")
INDEX_HEAD = "# Evaluation Runs Index\n\n| run_id | timestamp | n | avg_overall | badcase |\n| --- | --- | --- | --- | --- |"


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def flat(results: DataFrame) -> DataFrame:
    """The fifteen columns of (qid, answer_type, question, judge, retrieved, error), all texts; blanks where there's no judgement.

    ``retrieved``: an array of (source, distance), best first.
    """
    first = F.get("retrieved", 0)
    values = {x: _blank(F.col(f"judge.{x}")) for x in (*SCORES, "error_type", "reason")} | {
        "n_retrieved": F.coalesce(F.size("retrieved"), F.lit(0)).cast("string"), "top1_source": _blank(first["source"]),
        "top1_distance": F.when(first["distance"].isNotNull(), F.format_string("%.4f", first["distance"])).otherwise(""),
        "has_error": (F.coalesce(F.col("error"), F.lit("")) != "").cast("int").cast("string"),
    }
    return results.select(*(values.get(x, F.col(x)).alias(x) for x in FLAT))


def write_flat(results: DataFrame, path: str) -> None:
    flat(results).write.option("header", True).csv(path)


def view(rows: DataFrame, names: dict[str, str], error_type: str | None = None, most: int | None = None, part: str | None = None) -> DataFrame:
    """A flat file as a dashboard shows it: columns renamed, then filtered by error type, overall score and part of the question."""
    rows = rows.withColumnsRenamed(names)
    if error_type is not None:
        rows = rows.filter(F.col("error_type") == error_type)
    if most is not None:
        rows = rows.filter(F.col("overall").try_cast("int") <= most)
    return rows if part is None else rows.filter(F.contains(F.lower("question"), F.lower(F.lit(part))))


def score_bar(score: Column, total: int = 5) -> Column:
    return F.when(score < 1, "—").otherwise(F.concat(F.repeat(F.lit("█"), score), F.repeat(F.lit("░"), total - score), F.lit(" "), score.cast("string")))


def result_sections(results: DataFrame, below: int = BAD_BELOW) -> DataFrame:
    """qid, section: each result's part of a Markdown report."""
    o = F.col("judge.overall")
    badge = F.when(o < below, "🔴").when(o == 5, "⭐").otherwise("🟢")
    scores = F.concat_ws("\n", *(F.concat(F.lit(f"| {x} | "), score_bar(F.col(f"judge.{x}")), F.lit(" |")) for x in SCORES))
    judged = F.concat(F.lit("| 维度 | 评分 |\n| --- | --- |\n"), scores, F.lit("\n- **error_type**: `"), _blank(F.col("judge.error_type")), F.lit("`"))
    head = F.concat_ws(" · ", F.nullif("answer_type", F.lit("")), F.when(o.isNotNull(), F.concat(badge, F.lit(" overall="), o.cast("string"))))
    body = F.concat(
        F.lit("## "), F.col("qid"), F.lit("\n"), head, F.lit("\n### Question\n"), F.coalesce(F.nullif("question", F.lit("")), F.lit("_(空)_")),
        F.lit("\n### Judge Evaluation\n"), F.when(F.col("judge").isNotNull(), judged).otherwise("_未评测_"),
    )
    return results.select("qid", body.alias("section"))


def block_bar(score: Column, most: int = 5) -> Column:
    """A score as full and empty blocks; '' where there is none. Scores beyond the ends are drawn as the ends."""
    full = F.greatest(F.lit(0), F.least(F.lit(most), score.cast("int")))
    return F.when(score.isNotNull(), F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(most) - full))).otherwise("")


def bad_list(results: DataFrame, below: int = BAD_BELOW) -> DataFrame:
    """qid, overall, error_type of bad cases, worst first, then by qid."""
    rows = results.select("qid", "judge.overall", "judge.error_type").filter(F.col("overall") < below)
    return rows.orderBy("overall", "qid")


def error_table(results: DataFrame, below: int = BAD_BELOW) -> DataFrame:
    """error_type, n_bad, n_all: the counts of the bad-case report; every type but none has a row, none only if it occurs."""
    spark = results.sparkSession
    types = spark.createDataFrame([(x,) for x in ERROR_TYPES], "error_type string")
    found = results.filter("judge is not null").groupBy("judge.error_type").agg(F.count_if(F.col("judge.overall") < below).alias("n_bad"), F.count("*").alias("n_all"))
    rows = found.join(types.withColumn("_known", F.lit(1)), "error_type", "full_outer").filter("_known = 1 or error_type = 'none'")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("error_type", F.when(F.col("error_type") == "none", 0).otherwise(zero("n_bad")).cast("long").alias("n_bad"), zero("n_all").alias("n_all"))


def runs_index(runs: DataFrame) -> DataFrame:
    """One row: the index page of (run_id, timestamp, n, avg_overall, n_bad), newest first. Runs are few: one line each."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(x).cast("string") for x in ("run_id", "timestamp", "n", "avg_overall", "n_bad"))), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "run_id", line.alias("line"))), asc=False), lambda x: x["line"])
    return runs.agg(F.concat_ws("\n", F.lit(INDEX_HEAD), F.array_join(lines, "\n")).alias("page"))


def write_pages(pages: DataFrame, path: str, column: str = "section") -> None:
    """Markdown parts as text files."""
    pages.select(column).write.option("lineSep", "\n\n").text(path)


def save_run(run: DataFrame, path: str) -> None:
    """A nested run (one row) as one JSON file, that ``runs`` reads again."""
    run.coalesce(1).write.mode("errorifexists").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; a folder that's there already is never overwritten."""
    chunks.write.mode("errorifexists").json(path)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """section, n, share, n_fallback, n_papers: where chunks come from, most first."""
    total = F.sum("n").over(_every())
    rows = chunks.groupBy("section").agg(
        F.count("*").alias("n"), F.count_if(F.col("chunking_mode") == "fallback_fixed").alias("n_fallback"), F.countDistinct("paper_id").alias("n_papers")
    )
    return rows.select("section", "n", F.round(F.col("n") / total, 6).alias("share"), "n_fallback", "n_papers")


def _every():
    from pyspark.sql import Window

    return Window.partitionBy()


def dedup_reports(records: DataFrame, staged: DataFrame) -> dict[str, DataFrame]:
    """manifest, duplicates, rejected and unresolved rows of a staged dedup."""
    rows = records.withColumn("text_length", F.length(F.coalesce("text", F.lit("")))).join(staged, "id")
    reason = F.when(F.col("source_group") == "papers_rejected_prior", "prior_rejected").otherwise(F.col("doc_type"))
    kept, about = rows.filter("disposition = 'kept'"), ("id", "sha256", "doi", "title", "text_length", "source_group")
    return {
        "manifest": kept.select("resolution", *about),
        "duplicates": rows.filter("survivor is not null").select(F.col("disposition").alias("dup_kind"), "survivor", *about),
        "rejected": rows.filter("disposition = 'rejected'").select("doc_type", reason.alias("reject_reason"), *about),
        "unresolved": kept.filter("resolution = 'unresolved'").select(*about),
    }


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    for name, rows in reports.items():
        rows.write.option("header", True).csv(f"{path}/{name}")
