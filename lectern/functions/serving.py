"""The service's contract as expressions: requests that are valid, what a hit shows, fallback answers, usage and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapsed

# Bounds of a request, its modes and roles, fallback answers by reason, and the fields of usage.
QUESTION, PROMPT, MESSAGES, TOP_K, TEMPERATURE = 8000, 16000, 50, 20, 2
ANSWER_MODES, ROLES = ("quick", "detailed"), ("system", "user", "assistant")
FALLBACKS = {
    "prompt_injection": "该请求试图绕过知识库规则或要求伪造信息，我不能执行。请改为询问可由当前文献证据支持的问题。",
    "needs_clarification": "这个问题缺少关键限定。请补充具体污染物、处理工艺、实验条件或评价指标后再查询。",
    "insufficient_evidence": "当前知识库中没有足够证据回答该问题。",
}
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
PREVIEW, SNIPPET = 200, 900


def question_problem(question: Column, top_k: Column, mode: Column) -> Column:
    """Why a request isn't valid, or null: its question's length, its number of chunks, its mode."""
    n = F.length(F.coalesce(question, F.lit("")))
    return (
        F.when(~n.between(1, QUESTION), "question").when(top_k.isNotNull() & ~top_k.between(1, TOP_K), "top_k")
        .when(~F.coalesce(mode, F.lit("quick")).isin(*ANSWER_MODES), "answer_mode")
    )


def chat_problem(prompt: Column, messages: Column, temperature: Column) -> Column:
    """Why a chat isn't valid, or null. ``messages``: an array of (role, content), which goes before ``prompt``."""
    bad_role = F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    bad_text = F.exists(messages, lambda m: ~F.length(F.coalesce(m["content"], F.lit(""))).between(1, PROMPT))
    return (
        F.when(prompt.isNull() & messages.isNull(), "nothing")
        .when(prompt.isNotNull() & ~F.length(prompt).between(1, PROMPT), "prompt")
        .when(F.size(messages) > MESSAGES, "messages").when(bad_role, "role").when(bad_text, "content")
        .when(~F.coalesce(temperature, F.lit(0.2)).between(0, TEMPERATURE), "temperature")
    )


def shown_hit(text: Column, distance: Column, fields: dict[str, Column]) -> Column:
    """A hit as it is sent: names are texts, never null; numbers stay as they are."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    metadata = F.struct(*((named(fields[x]) if x in ("source", "paper_id") else fields[x]).alias(x) for x in fields))
    return F.struct(named(text).alias("text"), distance.alias("distance"), metadata.alias("metadata"))


def fallback(question: Column, reason: Column, mode: Column, rewrite: Column) -> Column:
    """The answer where the pipeline doesn't answer: null without a reason."""
    said = F.create_map(*(F.lit(x) for pair in FALLBACKS.items() for x in pair))
    answer = F.struct(
        question.alias("question"), F.try_element_at(said, reason).alias("answer"), F.coalesce(mode, F.lit("quick")).alias("answer_mode"),
        F.lit(0).alias("context_count"), F.coalesce(rewrite, question).alias("query_rewrite"), F.lit(True).alias("fallback"),
        reason.alias("fallback_reason"), F.lit("insufficient").alias("evidence_status"),
    )
    return F.when(reason.isin(*FALLBACKS), answer)


def usage(response: Column) -> Column:
    """Struct of the three token counts in a response's JSON; null where it names none."""
    counts = [F.get_json_object(response, f"$.usage.{x}").try_cast("long") for x in USAGE]
    return F.when(F.coalesce(*counts).isNotNull(), F.struct(*(c.alias(x) for c, x in zip(counts, USAGE, strict=True))))


def preview(text: Column) -> Column:
    """What a trace keeps of a text."""
    return F.substring(collapsed(F.coalesce(text, F.lit(""))), 1, PREVIEW)


def sources_block(sources: Column) -> Column:
    """Sources (sid, source, page, distance, text) as a judge reads them."""
    one = lambda s: F.concat(
        F.lit("["), s["sid"], F.lit("] "), s["source"], F.lit(" | page "), s["page"].cast("string"), F.lit(" | distance="), F.format_string("%.4f", s["distance"]),
        F.lit("\n"), F.substring(F.replace(F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.lit(" ")), 1, SNIPPET),
    )
    return F.when(F.size(sources) > 0, F.array_join(F.transform(sources, one), "\n\n")).otherwise("(无检索结果)")


def conditional_ok(predicted: Column, answer: Column, marks: Column, substantive: tuple[str, ...]) -> Column:
    """Whether a substantive answer cites something and holds all its marks."""
    text = F.coalesce(answer, F.lit(""))
    return predicted.isin(*substantive) & text.rlike(r"(?i)\[S\d+\]") & F.forall(F.coalesce(marks, F.array().cast("array<string>")), lambda m: F.contains(text, m))


def index_status(built: Column, live: Column) -> Column:
    """missing, stale, failed or ready, from what an index was built from and what is live (structs of version, name, mode, chunks)."""
    same = lambda x: built[x].eqNullSafe(live[x])
    return (
        F.when(built.isNull() | live.isNull(), "missing").when(F.coalesce(built["chunks"], F.lit(-1)) < 0, "failed")
        .when(~(same("version") & same("name") & same("mode")), "stale").otherwise("ready")
    )


def is_ready(knowledge: Column, vectors: Column, model: Column, embedding: Column, warm: Column, sparse_status: Column, mode: Column) -> Column:
    """All six conditions; the sparse index counts in hybrid modes only."""
    sparse = ~mode.isin("hybrid_dense_sparse", "hybrid_reranker") | (sparse_status == "ready")
    every = knowledge & vectors & model & embedding & warm & sparse
    return F.coalesce(every, F.lit(False))
