"""Queries over the service's contract: requests, fallback answers, hits as they are sent, usage, previews, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import routing as G
from lectern.functions import serving as S
from lectern.operators import metrics as M

from . import adapters as A
from .registry import registry

QUERIES, ORACLES, query = registry()


def turns(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query(f"""SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) NOT BETWEEN 1 AND {S.QUESTION} THEN 'question' WHEN turn % 5 = 1 AND turn - 1 NOT BETWEEN 1 AND {S.TOP_K} THEN 'top_k'
WHEN conv_id % 6 = 0 THEN 'answer_mode' END AS problem FROM conversations""")
def request_validate(spark, d):
    top_k = F.when(F.col("turn") % 5 == 1, F.col("turn") - 1)
    mode = F.when(F.col("conv_id") % 6 == 0, "deep").when(F.col("conv_id") % 6 == 1, "detailed")
    return turns(spark, d).select("conv_id", "turn", S.question_problem(F.col("text"), top_k, mode).alias("problem"))


@query(f"""WITH c AS (SELECT conv_id, list({{'role': CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 'tool' ELSE role END, 'content': CASE WHEN conv_id % 7 = 4 THEN '' ELSE text END}}) AS m FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 7 = 1 THEN 'nothing' WHEN conv_id % 7 = 2 THEN 'prompt' WHEN len(m) > {S.MESSAGES} AND conv_id % 7 <> 6 THEN 'messages'
WHEN conv_id % 7 <> 6 AND len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'role'
WHEN conv_id % 7 <> 6 AND len(list_filter(m, lambda x: length(x.content) NOT BETWEEN 1 AND {S.PROMPT})) > 0 THEN 'content' WHEN conv_id % 7 = 5 THEN 'temperature' END AS problem FROM c""")
def chat_validate(spark, d):
    """Whole conversations as chats; every seventh breaks another rule."""
    k = F.col("conv_id") % 7
    rows = turns(spark, d).select(
        "conv_id", F.struct(F.when((k == 3) & (F.col("turn") == 1), "tool").otherwise(F.col("role")).alias("role"), F.when(k == 4, "").otherwise(F.col("text")).alias("content")).alias("m")
    )
    chats = rows.groupBy("conv_id").agg(F.collect_list("m").alias("all"))
    messages = F.when(~k.isin(1, 6), F.col("all"))
    prompt = F.when(k == 2, "").when(k == 6, "hello")
    return chats.select("conv_id", S.chat_problem(prompt, messages, F.when(k == 5, 2.5)).alias("problem"))


_REASON = "CASE conv_id % 4 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'needs_clarification' WHEN 2 THEN 'insufficient_evidence' END"


@query(f"""WITH r AS (SELECT conv_id, turn, text, {_REASON} AS reason FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE reason {' '.join(f"WHEN '{k}' THEN {A.q(v)}" for k, v in S.FALLBACKS.items())} END AS answer, CASE WHEN turn % 2 = 0 THEN 'quick' ELSE 'detailed' END AS answer_mode, 0 AS context_count,
text AS query_rewrite, true AS fallback, reason AS fallback_reason, 'insufficient' AS evidence_status FROM r WHERE reason IS NOT NULL""")
def fallback_records(spark, d):
    k = F.col("conv_id") % 4
    reason = F.when(k == 0, "prompt_injection").when(k == 1, "needs_clarification").when(k == 2, "insufficient_evidence")
    mode = F.when(F.col("turn") % 2 != 0, "detailed")
    rows = turns(spark, d).filter("role = 'user'").withColumn("f", S.fallback(F.col("text"), reason, mode, F.lit(None).cast("string"))).filter("f is not null")
    return rows.select("conv_id", "turn", *(f"f.{x}" for x in ("answer", "answer_mode", "context_count", "query_rewrite", "fallback", "fallback_reason", "evidence_status")))


@query("""SELECT doc_id, text AS shown, (doc_id % 100) / 100.0 AS distance, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') AS source, 'd' || doc_id AS paper_id, CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 END AS page FROM documents""")
def shown_hits(spark, d):
    i = F.col("doc_id")
    fields = {"source": F.when(i % 3 > 0, F.col("source")), "paper_id": F.concat(F.lit("d"), i), "page": F.when(i % 5 > 0, i % 9)}
    rows = A.read(spark, d, "documents").withColumn("h", S.shown_hit(F.col("text"), (i % 100) / 100.0, fields))
    return rows.select("doc_id", F.col("h.text").alias("shown"), "h.distance", "h.metadata.source", "h.metadata.paper_id", "h.metadata.page")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN user_id END AS prompt_tokens, CASE WHEN event_id % 4 = 0 THEN event_id END AS completion_tokens, NULL::BIGINT AS total_tokens FROM events""")
def usage_fields(spark, d):
    """Responses whose usage is whole, in part, empty or missing."""
    k = F.col("event_id") % 4
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit('{"usage": {"prompt_tokens": '), u, F.lit(', "completion_tokens": '), e, F.lit("}}")))
        .when(k == 1, F.concat(F.lit('{"usage": {"prompt_tokens": "'), u, F.lit('", "total_tokens": "many"}}'))).when(k == 2, '{"usage": {}}')
    )
    rows = A.read(spark, d, "events").withColumn("u", S.usage(body))
    return rows.select("event_id", *(f"u.{x}" for x in S.USAGE))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS preview FROM documents")
def trace_preview(spark, d):
    return A.read(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '(无检索结果)' ELSE '[S1] ' || source || ' | page ' || (doc_id % 9) || ' | distance=' || printf('%.4f', (doc_id % 97)::DOUBLE / 97) || chr(10) || left(replace(text, chr(10), ' '), 900) END AS block FROM documents""")
def judge_sources(spark, d):
    i = F.col("doc_id")
    one = F.array(F.struct(F.lit("S1").alias("sid"), "source", (i % 9).alias("page"), ((i % 97).cast("double") / 97).alias("distance"), "text"))
    return A.read(spark, d, "documents").select("doc_id", S.sources_block(F.when(i % 7 == 0, F.slice(one, 1, 0)).otherwise(one)).alias("block"))


@query("""SELECT item_id, item_id % 4 <> 1 AND item_id % 3 <> 0 AND (item_id % 5 <> 0 OR contains(text, 'the')) AS ok FROM benchmark""")
def conditional_checks(spark, d):
    """Whether an answer that has to name its conditions does, with a citation."""
    i = F.col("item_id")
    predicted = F.when(i % 4 == 1, "refuse").otherwise("answer")
    answer = F.concat("text", F.when(i % 3 != 0, " [S1]").otherwise(""))
    marks = F.when(i % 5 == 0, F.array(F.lit("the")))
    return A.read(spark, d, "benchmark").select("item_id", S.conditional_ok(predicted, answer, marks, M.SUBSTANTIVE).alias("ok"))


_STATUS = """st AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'failed' WHEN doc_id % 6 IN (2, 3) THEN 'stale' ELSE 'ready' END AS status FROM documents)"""


@query(f"""WITH {_STATUS} SELECT doc_id, status, doc_id % 10 <> 9 AND (doc_id % 3 = 0 OR status = 'ready') AS ready FROM st""")
def index_freshness(spark, d):
    """An index built for each document: without manifest, unreadable, from another version or mode, or fresh."""
    i = F.col("doc_id")
    k = i % 6
    state = lambda version, mode, chunks: F.struct(version.alias("version"), F.lit("main").alias("name"), mode.alias("mode"), chunks.alias("chunks"))
    live = state(F.col("source"), F.lit("section_aware"), F.length("text"))
    built = F.when(k != 0, state(F.when(k == 2, "old").otherwise(F.col("source")), F.when(k == 3, "fixed").otherwise("section_aware"), F.when(k != 1, F.length("text"))))
    rows = A.read(spark, d, "documents").withColumn("status", S.index_status(built, live))
    mode = F.when(i % 3 == 0, "dense_only").when(i % 3 == 1, "hybrid_dense_sparse").otherwise("hybrid_reranker")
    yes = F.lit(True)
    return rows.select("doc_id", "status", S.is_ready(yes, yes, i % 10 != 9, yes, yes, F.col("status"), mode).alias("ready"))


@query(f"""SELECT doc_id, CASE WHEN n_chars / 4000.0 <= 0.6 THEN 'High' WHEN n_chars / 4000.0 <= 1.0 THEN 'Medium' ELSE 'Low' END AS band,
CASE WHEN doc_id % 4 = 0 THEN 'refuse' WHEN doc_id % 4 = 1 THEN 'clarify' ELSE 'answer' END AS predicted FROM documents""")
def relevance_and_refusal(spark, d):
    """The band that a distance is shown as, and answers that turn out to be refusals."""
    i = F.col("doc_id")
    found = F.when(i % 4 == 1, "clarify").otherwise("answer")
    answer = F.when(i % 4 < 2, F.concat(F.lit("当前"), F.lit(G.NO_EVIDENCE_PHRASE))).otherwise(F.col("text"))
    return A.read(spark, d, "documents").select("doc_id", G.relevance_band(F.col("n_chars") / 4000.0).alias("band"), G.predicted_action(found, answer).alias("predicted"))
