"""Evaluation: gold spans, retrieval and behaviour metrics, judge summaries, gates, intervals. Aggregates over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BAD_BELOW = 4
#: Error types in the order of reports, and the release gate.
ERROR_TYPES = ("retrieval_miss", "wrong_evidence", "incomplete_answer", "hallucination", "citation_error", "off_topic", "format_error")
GATE = (
    ("recall10", 0.70, ">="), ("page_hit10", 0.55, ">="), ("span_hit10", 0.50, ">="), ("action_accuracy", 0.60, ">="),
    ("answerable_accuracy", 0.55, ">="), ("no_evidence_recall", 0.80, ">="), ("citation_support", 0.65, ">="), ("unsupported_claim", 0.25, "<="),
)
TRUST = ("citation_support", "unsupported_claim")
SUBSTANTIVE = ("answer", "partial_answer", "correct_premise")


def rate(condition: Column, of: Column | None = None) -> Column:
    """Share of rows that hold, of all or of those in ``of``; 0 where there are none."""
    if of is None:
        return F.round(F.count_if(condition) / F.greatest(F.lit(1), F.count("*")), 4)
    return F.round(F.count_if(condition & of) / F.greatest(F.lit(1), F.count_if(of)), 4)


def run_summary(results: DataFrame, threshold: int = BAD_BELOW) -> DataFrame:
    """One row a run over (qid, judge struct or null, error): correctness and evidence_relevance leave zeros out."""
    j = lambda x: F.col(f"judge.{x}")
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))
    judged = F.col("judge").isNotNull()
    positive = lambda x: F.when(j(x) > 0, j(x))
    return results.agg(
        F.count("*").alias("n"), F.count_if(judged).alias("n_judged"), F.count_if(F.col("error").isNotNull()).alias("n_errored"),
        F.count_if(judged & (j("overall") < threshold)).alias("n_bad"),
        mean(positive("correctness")).alias("avg_correctness"), mean(positive("evidence_relevance")).alias("avg_evidence_relevance"),
        *(mean(j(x)).alias(f"avg_{x}") for x in ("faithfulness", "completeness", "citation", "overall")),
    )


def bad_cases(results: DataFrame, types: DataFrame, threshold: int = BAD_BELOW) -> DataFrame:
    """error_type, n_bad, qids (sorted): every type has a row, and so has none; a report names each bad case."""
    bad = results.filter(F.col("judge.overall") < threshold).select(F.col("judge.error_type").alias("error_type"), "qid")
    grouped = bad.groupBy("error_type").agg(F.count("*").alias("n_bad"), F.array_join(F.array_sort(F.collect_list("qid")), ",").alias("qids"))
    return types.join(grouped, "error_type", "left").select("error_type", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("qids", F.lit("")).alias("qids"))


def behaviour(rows: DataFrame) -> DataFrame:
    """One row over (class, expected, predicted, status, n_used)."""
    p, c = F.col("predicted"), F.col("class")
    answered = p.isin(*SUBSTANTIVE)
    right = p == F.col("expected")
    return rows.agg(
        F.count("*").alias("n"), rate(right).alias("action_accuracy"), rate(right, c == "ANSWERABLE").alias("answerable_accuracy"),
        rate(right, c == "NO_EVIDENCE").alias("no_evidence_recall"), rate(right, c == "FALSE_PREMISE").alias("false_premise_correction"),
        rate(c == "AMBIGUOUS", p == "clarify").alias("clarify_precision"), rate(p == "clarify", c == "AMBIGUOUS").alias("clarify_recall"),
        rate(c == "NO_EVIDENCE", p == "refuse").alias("refuse_precision"), rate(p == "refuse", c == "NO_EVIDENCE").alias("refuse_recall"),
        rate(F.col("status") == "passed", answered).alias("citation_support"),
        rate((F.col("status") == "failed") | (F.col("n_used") == 0), answered).alias("unsupported_claim"),
    )


def by_action(rows: DataFrame) -> DataFrame:
    """class, predicted, n, accuracy over (class, expected, predicted)."""
    right = F.col("predicted") == F.col("expected")
    return rows.groupBy("class", "predicted").agg(F.count("*").alias("n"), rate(right).alias("accuracy"))


def split_checks(rows: DataFrame, one: str, other: str) -> DataFrame:
    """split, n, n_distinct, n_shared over (split, key): rows, different keys, and the pairs of equal keys of two splits.

    Pairs are counted as products of counts, so that a key that many rows of both have isn't multiplied out. Null keys are
    counted as rows and are equal to nothing.
    """
    counted = rows.groupBy("split", "key").agg(F.count("*").alias("c"))
    sizes = counted.groupBy("split").agg(F.sum("c").alias("n"), F.count("key").alias("n_distinct"))
    times = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col("c"))), F.lit(0))
    pairs = counted.filter("key is not null").groupBy("key").agg((times(one) * times(other)).alias("pairs"))
    return sizes.crossJoin(pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_shared")))


def attribution() -> Column:
    """The error of a case, OK where there is none, over retrieved, evidence_ok, right, status."""
    return (
        F.when(F.col("right"), "OK").when(~F.col("retrieved"), "RETRIEVAL_MISS").when(~F.col("evidence_ok"), "WRONG_EVIDENCE")
        .when(F.col("predicted") != F.col("expected"), "ANSWERABILITY_MISCLASSIFICATION").when(F.col("status") == "failed", "CITATION_ERROR").otherwise("GENERATION_ERROR")
    )


def miss_cause(dense: str, sparse: str, hybrid: str) -> Column:
    """Why a case's span wasn't reached, or how it was rescued; labels accumulate. The labels."""
    dn, sp, hy = (F.col(x) for x in (dense, sparse, hybrid))
    return F.array_join(F.array_compact(F.array(
        F.when(~dn & ~sp, "GOLD_SPAN_NOT_IN_TOP25"), F.when(dn & ~hy, "RRF_RANKING_LOSS"), F.when(~dn & sp & hy, "SPARSE_RESCUED")
    )), "+")


def gate(metrics: DataFrame) -> DataFrame:
    """metric, value, threshold, op, passed, verdict from one row that has the gate's metrics."""
    rows = metrics.select(F.explode(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(op).alias("op")) for m, t, op in GATE
    ))).alias("g")).select("g.*")
    rows = rows.withColumn("passed", F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))
    every = Window.partitionBy()
    core = F.bool_and(F.col("passed") | F.col("metric").isin(*TRUST)).over(every)
    verdict = F.when(F.bool_and("passed").over(every), "FINAL_ACCEPT").when(core, "FINAL_ACCEPT_WITH_LIMITATIONS").otherwise("FINAL_NOT_ACCEPTED")
    return rows.withColumn("verdict", verdict)


def bootstrap(rows: DataFrame, replicates: int = 2000) -> DataFrame:
    """mean, low, high of (id, value): percentile interval of resampled means.

    A row enters a replicate as often as a Poisson variable of mean 1 says, drawn from the MD5 of id and replicate (the first
    seven hex digits), so that no row has to know the others: one aggregation, the same on every run and in any engine.
    """
    digits = F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("rep").cast("string")).cast("binary")), 1, 7)
    u = F.conv(digits, 16, 10).cast("double") / (1 << 28)
    times = F.lit(0)
    for bound in poisson_bounds():
        times = times + (u >= bound).cast("int")
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("times", times)
    means = reps.groupBy("rep").agg((F.sum(F.col("value") * F.col("times")) / F.greatest(F.lit(1), F.sum("times"))).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    low, high = (F.round(F.element_at(ordered, int(share * replicates) + 1), 6) for share in (0.025, 0.975))
    return rows.agg(F.round(F.avg("value"), 6).alias("mean")).crossJoin(means.agg(low.alias("low"), high.alias("high")))


def poisson_bounds(most: int = 8) -> list[float]:
    """The chances that a Poisson variable of mean 1 is at most 0, 1, ... ``most`` - 1."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return out


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, score_v1, score_v2, delta, outcome of (qid, score) in two runs."""
    both = a.select("qid", F.col("score").alias("score_v1")).join(b.select("qid", F.col("score").alias("score_v2")), "qid")
    d = F.col("score_v2") - F.col("score_v1")
    return both.withColumns({"delta": d, "outcome": F.when(d > 0, "win").when(d < 0, "loss").otherwise("tie")})


def eval_judge(evals: DataFrame, judges: DataFrame) -> DataFrame:
    """Answers with their judgements: blank ids are no build rows, the last judgement (by seq) of an id wins."""
    last = judges.filter(F.trim(F.coalesce("qid", F.lit(""))) != "").groupBy("qid").agg(F.max_by(F.struct("overall", "error_type"), "seq").alias("judge"))
    return evals.join(last, "qid", "left")


def retrieved_sources(field: Column) -> Column:
    """Sources of a packed report field: ``[Sn] file | page p | distance=d`` joined by ``||``."""
    pattern = r"^\[?(S\d+)\]?\s+(.+?)\s*\|\s*page\s+(\d+)\s*\|\s*distance=([\d.]+)\s*$"
    parts = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), r"\|\|"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
    return F.transform(parts, lambda x: F.struct(
        F.regexp_extract(x, pattern, 1).alias("sid"), F.regexp_extract(x, pattern, 2).alias("source"),
        F.regexp_extract(x, pattern, 3).cast("int").alias("page"), F.regexp_extract(x, pattern, 4).cast("double").alias("distance"),
    ))


def judge_of(text: Column, schema: str = "overall int, error_type string") -> Column:
    """The judgement in a model's text: the text as JSON, or its widest braces; null where neither parses."""
    strict = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    loose = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
    return F.when(strict["overall"].isNotNull(), strict).otherwise(F.when(loose["overall"].isNotNull(), loose))
