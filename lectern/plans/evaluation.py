"""Queries over judgements, behaviour metrics and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import metrics as M
from lectern.sources import reports as O

from . import adapters as A
from .registry import registry

QUERIES, ORACLES, query = registry()

# --- judgements by rule from document ids

_TYPES = (*M.ERROR_TYPES, "none")
_J = f"""rs AS (SELECT 'q' || doc_id AS qid, doc_id, source, doc_id % 11 <> 0 AS judged, CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error, doc_id % 6 AS correctness, (doc_id // 2) % 6 AS evidence_relevance,
(doc_id // 3) % 6 AS faithfulness, (doc_id // 5) % 6 AS completeness, (doc_id // 7) % 6 AS citation, (doc_id // 4) % 6 AS overall, {A.sql_list(_TYPES)}[doc_id % 8 + 1] AS error_type FROM documents)"""


def results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    part = lambda n: (F.floor(i / n) % 6).cast("int")
    judge = F.struct(part(1).alias("correctness"), part(2).alias("evidence_relevance"), part(3).alias("faithfulness"), part(5).alias("completeness"), part(7).alias("citation"), part(4).alias("overall"), F.element_at(F.array(*map(F.lit, _TYPES)), (i % 8 + 1).cast("int")).alias("error_type"))
    return A.read(spark, d, "documents").select(F.concat(F.lit("q"), "doc_id").alias("qid"), "doc_id", "source", F.when(i % 11 != 0, judge).alias("judge"), F.when(i % 17 == 0, "timeout").alias("error"))


def _mean(c: str) -> str:
    return f"coalesce(round_even(avg({c}), 2), 0)"


@query(f"""WITH {_J} SELECT count(*) AS n, count(*) FILTER (WHERE judged) AS n_judged, count(error) AS n_errored, count(*) FILTER (WHERE judged AND overall < 4) AS n_bad,
{_mean('CASE WHEN judged AND correctness > 0 THEN correctness END')} AS avg_correctness, {_mean('CASE WHEN judged AND evidence_relevance > 0 THEN evidence_relevance END')} AS avg_evidence_relevance,
{', '.join(f"{_mean(f'CASE WHEN judged THEN {x} END')} AS avg_{x}" for x in ('faithfulness', 'completeness', 'citation', 'overall'))} FROM rs""")
def run_summary(spark, d):
    return M.run_summary(results(spark, d))


@query(f"WITH {_J}, t AS (SELECT unnest({A.sql_list(_TYPES)}) AS error_type), b AS (SELECT error_type, count(*) AS n_bad, string_agg(qid, ',' ORDER BY qid) AS qids FROM rs WHERE judged AND overall < 4 GROUP BY 1) SELECT error_type, coalesce(n_bad, 0) AS n_bad, coalesce(qids, '') AS qids FROM t LEFT JOIN b USING (error_type)")
def badcase_groups(spark, d):
    return M.bad_cases(results(spark, d), A.values(spark, [(x,) for x in _TYPES], "error_type string"))


@query(f"WITH {_J} SELECT qid, overall AS score_v1, (overall + doc_id % 3) AS score_v2, doc_id % 3 AS delta, CASE WHEN doc_id % 3 > 0 THEN 'win' ELSE 'tie' END AS outcome FROM rs WHERE judged AND doc_id % 5 <> 0")
def run_compare(spark, d):
    a = results(spark, d).filter("judge is not null").select("qid", "doc_id", F.col("judge.overall").alias("score"))
    return M.compared(a, a.filter("doc_id % 5 <> 0").withColumn("score", F.col("score") + F.col("doc_id") % 3))


_SCORED = ", ".join(f"CASE WHEN judged THEN {x}::VARCHAR ELSE '' END AS {x}" for x in O.SCORES)


@query(f"""WITH {_J} SELECT qid, '' AS answer_type, source AS question, {_SCORED}, CASE WHEN judged THEN error_type ELSE '' END AS error_type, '' AS reason,
CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '1' END AS n_retrieved, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS top1_source,
CASE WHEN doc_id % 3 = 0 THEN '' ELSE printf('%.4f', (doc_id % 97)::DOUBLE / 97) END AS top1_distance, (error IS NOT NULL)::INT::VARCHAR AS has_error FROM rs""")
def flat_csv(spark, d):
    return O.flat(detailed(spark, d))


def detailed(spark: SparkSession, d: str) -> DataFrame:
    """Results with their first hit; two of three have one."""
    i = F.col("doc_id")
    hit = F.array(F.struct(F.col("source"), ((i % 97).cast("double") / 97).alias("distance")))
    rows = results(spark, d).withColumn("judge", F.when(F.col("judge").isNotNull(), F.struct("judge.*", F.lit("").alias("reason"))))
    return rows.select("qid", "doc_id", F.lit("").alias("answer_type"), F.col("source").alias("question"), "judge", F.when(i % 3 != 0, hit).otherwise(F.slice(hit, 1, 0)).alias("retrieved"), "error")


@query(f"""WITH {_J} SELECT qid AS id, overall::VARCHAR AS overall FROM rs WHERE judged AND error_type = 'hallucination' AND overall <= 3 AND contains(lower(source), 'src1')""")
def view_flat_csv(spark, d):
    """A dashboard's view of the flat file."""
    return O.view(O.flat(detailed(spark, d)), {"qid": "id"}, "hallucination", 3, "SRC1").select("id", "overall")


def _bar(x: str) -> str:
    return f"'| {x} | ' || CASE WHEN {x} < 1 THEN '—' ELSE repeat('█', {x}::INT) || repeat('░', 5 - {x}::INT) || ' ' || {x} END || ' |'"


@query(f"""WITH {_J} SELECT qid, '## ' || qid || chr(10) || CASE WHEN judged THEN CASE WHEN overall < 4 THEN '🔴' WHEN overall = 5 THEN '⭐' ELSE '🟢' END || ' overall=' || overall ELSE '' END
|| chr(10) || '### Question' || chr(10) || source || chr(10) || '### Judge Evaluation' || chr(10) || CASE WHEN judged THEN '| 维度 | 评分 |' || chr(10) || '| --- | --- |' || chr(10)
|| concat_ws(chr(10), {', '.join(_bar(x) for x in O.SCORES)}) || chr(10) || '- **error_type**: `' || error_type || '`' ELSE '_未评测_' END AS section FROM rs""")
def markdown_sections(spark, d):
    return O.result_sections(detailed(spark, d))


@query(f"WITH {_J} SELECT qid, overall, error_type FROM rs WHERE judged AND overall < 4 ORDER BY overall, qid")
def badcase_list(spark, d):
    return O.bad_list(results(spark, d))


@query(f"""WITH {_J}, f AS (SELECT error_type, count(*) FILTER (WHERE overall < 4) AS n_bad, count(*) AS n_all FROM rs WHERE judged GROUP BY 1), t AS (SELECT unnest({A.sql_list(M.ERROR_TYPES)}) AS error_type)
SELECT error_type, coalesce(n_bad, 0) AS n_bad, coalesce(n_all, 0) AS n_all FROM t LEFT JOIN f USING (error_type) UNION ALL SELECT error_type, 0, n_all FROM f WHERE error_type = 'none'""")
def error_histogram(spark, d):
    return O.error_table(results(spark, d))


@query(f"""WITH r AS (SELECT source AS run_id, '2026-01-' || lpad((count(*) % 28 + 1)::VARCHAR, 2, '0') AS timestamp, count(*) AS n, max(doc_id) AS top, min(doc_id) AS low FROM documents GROUP BY 1)
SELECT {A.q(O.INDEX_HEAD)} || chr(10) || string_agg('| ' || concat_ws(' | ', run_id, timestamp, n, top, low) || ' |', chr(10) ORDER BY timestamp DESC, run_id DESC) AS page FROM r""")
def runs_index(spark, d):
    rows = A.read(spark, d, "documents").groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("n"), F.max("doc_id").alias("avg_overall"), F.min("doc_id").alias("n_bad"))
    stamp = F.concat(F.lit("2026-01-"), F.lpad((F.col("n") % 28 + 1).cast("string"), 2, "0"))
    return O.runs_index(rows.withColumn("timestamp", stamp))


@query(f"""WITH {_J}, jd AS (SELECT CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE qid END AS qid, overall, error_type, 1 AS seq FROM rs WHERE judged UNION ALL SELECT qid, 5, 'none', 2 FROM rs WHERE doc_id % 9 = 0),
l AS (SELECT qid, max_by(overall, seq) AS overall, max_by(error_type, seq) AS error_type FROM jd WHERE trim(qid) <> '' GROUP BY 1) SELECT r.qid, l.overall, l.error_type FROM rs r LEFT JOIN l USING (qid)""")
def eval_judge_join(spark, d):
    rows = results(spark, d)
    first = rows.filter("judge is not null").select(F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("qid")).alias("qid"), "judge.overall", "judge.error_type", F.lit(1).alias("seq"))
    again = rows.filter("doc_id % 9 = 0").select("qid", F.lit(5).alias("overall"), F.lit("none").alias("error_type"), F.lit(2).alias("seq"))
    return M.eval_judge(rows.select("qid"), first.union(again)).select("qid", "judge.overall", "judge.error_type")


@query(f"WITH {_J} SELECT qid FROM rs WHERE NOT judged AND error IS NULL")
def incremental_judge(spark, d):
    """What a judging run still has to do: answers without error that have no judgement yet."""
    rows = results(spark, d)
    return rows.filter("error is null").join(rows.filter("judge is not null").select("qid"), "qid", "left_anti").select("qid")


@query(f"WITH {_J} SELECT qid, CASE WHEN judged THEN repeat('█', overall::INT) || repeat('░', 5 - overall::INT) ELSE '' END AS bar, regexp_replace(lower(source || ' ' || error_type), '[^a-z0-9]+', '_', 'g') AS slug, round(doc_id * 100.0 / 7, 2) AS share FROM rs")
def report_fields(spark, d):
    from lectern.functions.text import slug
    from lectern.sources.reports import block_bar

    o = F.col("judge.overall")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return results(spark, d).select("qid", block_bar(o).alias("bar"), slug(F.concat_ws(" ", "source", kind)).alias("slug"), F.round(F.col("doc_id") * 100.0 / 7, 2).alias("share"))


# --- behaviour by rule from labels

BEHAVIOUR = """bh AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'ANSWERABLE' WHEN quality = 0 AND toxic = 0 THEN 'NO_EVIDENCE' WHEN quality = 1 THEN 'FALSE_PREMISE' ELSE 'AMBIGUOUS' END AS class,
CASE WHEN quality = 1 AND toxic = 0 THEN 'answer' WHEN quality = 0 AND toxic = 0 THEN 'refuse' WHEN quality = 1 THEN 'correct_premise' ELSE 'clarify' END AS expected,
CASE WHEN n_chars % 10 < 6 THEN 'answer' WHEN n_chars % 10 < 8 THEN 'refuse' WHEN n_chars % 10 = 8 THEN 'clarify' ELSE 'correct_premise' END AS predicted,
CASE n_chars % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'corrected' ELSE 'failed' END AS status, n_chars % 2 AS n_used, n_chars FROM labels JOIN documents USING (doc_id))"""


def behaviours(spark, d):
    q, t, n = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars")
    rows = A.read(spark, d, "labels").join(A.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(
        "doc_id", F.when(q & ~t, "ANSWERABLE").when(~q & ~t, "NO_EVIDENCE").when(q, "FALSE_PREMISE").otherwise("AMBIGUOUS").alias("class"),
        F.when(q & ~t, "answer").when(~q & ~t, "refuse").when(q, "correct_premise").otherwise("clarify").alias("expected"),
        F.when(n % 10 < 6, "answer").when(n % 10 < 8, "refuse").when(n % 10 == 8, "clarify").otherwise("correct_premise").alias("predicted"),
        F.when(n % 3 == 0, "passed").when(n % 3 == 1, "corrected").otherwise("failed").alias("status"), (n % 2).alias("n_used"), "n_chars",
    )


def _rate(hit: str, of: str = "true") -> str:
    return f"round(count(*) FILTER (WHERE ({hit}) AND ({of})) / greatest(1, count(*) FILTER (WHERE {of})), 4)"


_ANS = "predicted IN ('answer', 'partial_answer', 'correct_premise')"
METRICS = f"""bm AS (SELECT count(*) AS n, {_rate('predicted = expected')} AS action_accuracy, {_rate('predicted = expected', "class = 'ANSWERABLE'")} AS answerable_accuracy, {_rate('predicted = expected', "class = 'NO_EVIDENCE'")} AS no_evidence_recall,
{_rate('predicted = expected', "class = 'FALSE_PREMISE'")} AS false_premise_correction, {_rate("class = 'AMBIGUOUS'", "predicted = 'clarify'")} AS clarify_precision, {_rate("predicted = 'clarify'", "class = 'AMBIGUOUS'")} AS clarify_recall,
{_rate("class = 'NO_EVIDENCE'", "predicted = 'refuse'")} AS refuse_precision, {_rate("predicted = 'refuse'", "class = 'NO_EVIDENCE'")} AS refuse_recall, {_rate("status = 'passed'", _ANS)} AS citation_support, {_rate("status = 'failed' OR n_used = 0", _ANS)} AS unsupported_claim FROM bh)"""


@query(f"WITH {BEHAVIOUR}, {METRICS} SELECT * FROM bm")
def behavior_pr(spark, d):
    return M.behaviour(behaviours(spark, d))


@query(f"WITH {BEHAVIOUR} SELECT class, predicted, count(*) AS n, {_rate('predicted = expected')} AS accuracy FROM bh GROUP BY 1, 2")
def citation_rates(spark, d):
    return M.by_action(behaviours(spark, d))


@query(f"""WITH {BEHAVIOUR}, att AS (SELECT CASE WHEN predicted = expected AND status <> 'failed' THEN 'OK' WHEN n_chars % 5 = 0 THEN 'RETRIEVAL_MISS' WHEN n_chars % 7 = 0 THEN 'WRONG_EVIDENCE' WHEN predicted <> expected THEN 'ANSWERABILITY_MISCLASSIFICATION' WHEN status = 'failed' THEN 'CITATION_ERROR' ELSE 'GENERATION_ERROR' END AS error,
class, predicted FROM bh) SELECT error, count(*) AS n, count(*) FILTER (WHERE class = 'NO_EVIDENCE' AND predicted = 'answer') AS answered_but_should_refuse, count(*) FILTER (WHERE class = 'ANSWERABLE' AND predicted = 'refuse') AS refused_but_should_answer FROM att GROUP BY 1""")
def error_attribution(spark, d):
    n = F.col("n_chars")
    rows = behaviours(spark, d).withColumns({"right": (F.col("predicted") == F.col("expected")) & (F.col("status") != "failed"), "retrieved": n % 5 != 0, "evidence_ok": n % 7 != 0})
    rows = rows.withColumn("error_kind", M.attribution())
    return rows.groupBy(F.col("error_kind").alias("error")).agg(
        F.count("*").alias("n"), F.count_if((F.col("class") == "NO_EVIDENCE") & (F.col("predicted") == "answer")).alias("answered_but_should_refuse"), F.count_if((F.col("class") == "ANSWERABLE") & (F.col("predicted") == "refuse")).alias("refused_but_should_answer")
    )


_TIMES = " + ".join(f"(u >= {b!r})::INT" for b in M.poisson_bounds())


@query(f"""WITH {BEHAVIOUR}, v AS (SELECT doc_id AS id, (predicted = expected)::INT::DOUBLE AS value FROM bh),
u AS (SELECT value, rep, ('0x' || left(md5(id || '|' || rep), 7))::BIGINT::DOUBLE / {1 << 28} AS u FROM v, (SELECT unnest(range(1, 2001)) AS rep)),
m AS (SELECT rep, sum(value * t) / greatest(1, sum(t)) AS m FROM (SELECT *, {_TIMES} AS t FROM u) GROUP BY rep),
o AS (SELECT list_sort(list(m)) AS o FROM m)
SELECT (SELECT round(avg(value), 6) FROM v) AS mean, round(o[51], 6) AS low, round(o[1951], 6) AS high FROM o""")
def bootstrap_ci(spark, d):
    rows = behaviours(spark, d).select(F.col("doc_id").alias("id"), (F.col("predicted") == F.col("expected")).cast("double").alias("value"))
    return M.bootstrap(rows)


@query("""SELECT doc_id AS id, 'S1' AS sid, source || '.pdf' AS source, (doc_id % 90 + 1)::INT AS page, (doc_id % 10000) / 10000 AS distance FROM documents WHERE doc_id % 6 NOT IN (4, 5)
UNION ALL SELECT doc_id, 'S2', 'b c ' || source || '.pdf', 11, 0.5 FROM documents WHERE doc_id % 6 IN (0, 1) UNION ALL SELECT doc_id, 'S3', 'x.pdf', 4, 1 FROM documents WHERE doc_id % 6 IN (3, 5)""")
def sources_parse(spark, d):
    """The packed report field of every document: its own source, a second one, one without brackets, and what is none."""
    k = F.col("doc_id") % 6
    distance = F.format_string("%.4f", (F.col("doc_id") % 10000) / 10000)
    own = F.concat(F.lit("[S1] "), "source", F.lit(".pdf | page "), F.col("doc_id") % 90 + 1, F.lit(" | distance="), distance)
    second = F.concat(F.lit("[S2] b c "), "source", F.lit(".pdf|page 11 |  distance=0.5"))
    third = F.lit("junk || S3 x.pdf|page 4|distance=1")
    field = F.when(k.isin(0, 1), F.concat_ws(" || ", own, second)).when(k == 2, F.concat_ws("||", own, F.lit("[S4] a.pdf | page x | distance=0.1")))
    field = field.when(k == 3, F.concat_ws(" || ", own, third)).when(k == 5, third)
    return A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(M.retrieved_sources(field)).alias("s")).select("id", "s.*")


@query("""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, (conv_id * 7 + turn) % 6 AS mark FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN k < 3 THEN mark END::INT AS overall, CASE WHEN k < 3 THEN 'none' END AS error_type, k < 3 AS parsed FROM t""")
def judge_json(spark, d):
    """A judge's text about every answer: bare JSON, JSON between words and lines, none, a word for a number, nothing."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    json = F.to_json(F.struct(((F.col("conv_id") * 7 + F.col("turn")) % 6).alias("overall"), F.lit("none").alias("error_type")))
    said = F.translate(F.col("text"), "{}", "")
    text = F.when(k == 0, json).when(k == 1, F.concat(said, F.lit("\n"), json, F.lit(" done."))).when(k == 2, F.concat(F.lit("```json\n"), json, F.lit("\n```")))
    text = text.when(k == 3, said).when(k == 4, '{"overall": "x"}')
    rows = A.read(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", M.judge_of(text).alias("j"))
    return rows.select("conv_id", "turn", "j.overall", "j.error_type", F.col("j").isNotNull().alias("parsed"))


@query("""WITH k AS (SELECT CASE WHEN item_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split, lower(text) AS g FROM benchmark)
SELECT split, count(*) AS n, count(DISTINCT g) AS n_distinct, (SELECT count(*) FROM k a JOIN k b ON a.g = b.g AND a.split = 'dev' AND b.split = 'test') AS n_shared FROM k GROUP BY split""")
def split_set_checks(spark, d):
    split = F.when(F.col("item_id") % 3 == 0, "dev").otherwise("test")
    return M.split_checks(A.read(spark, d, "benchmark").select(split.alias("split"), F.lower("text").alias("key")), "dev", "test")


@query(f"""WITH {BEHAVIOUR} SELECT 'duplicate id' AS rule, count(*) AS n FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'class without action', count(*) FROM bh WHERE class = 'NO_EVIDENCE' AND expected <> 'refuse' UNION ALL SELECT 'paired case missing', count(*) FROM bh a WHERE doc_id + 1 NOT IN (SELECT doc_id FROM bh)""")
def integrity_checks(spark, d):
    labels, docs, b = A.read(spark, d, "labels"), A.read(spark, d, "documents"), behaviours(spark, d)
    count = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return (
        count("duplicate id", labels.groupBy("doc_id").count().filter("count > 1"))
        .union(count("label without document", labels.join(docs, "doc_id", "left_anti")))
        .union(count("class without action", b.filter("class = 'NO_EVIDENCE' and expected <> 'refuse'")))
        .union(count("paired case missing", b.select((F.col("doc_id") + 1).alias("p")).join(b.select(F.col("doc_id").alias("p")), "p", "left_anti")))
    )


