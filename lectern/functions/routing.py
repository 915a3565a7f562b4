"""Evidence, answerability and citations: every rule is an expression over a question and its hits.

``hits`` are arrays of structs with text (and page); the patterns are fixed values and so are the labels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, evidence_norm, let, numbers

MAX_DISTANCE = 1.15

# Patterns, by purpose.
INJECTION = (
    r"忽略(之前|以上|前面).{0,12}(指令|规则|提示)",
    r"(显示|泄露|输出).{0,12}(系统提示|api\s*key|密钥|凭据)",
    r"(伪造|编造).{0,8}(引用|文献|作者|页码)",
    r"ignore\s+(all\s+)?(previous|above).{0,24}(instructions?|rules?|prompts?)",
    r"(reveal|show|print).{0,24}(system\s+prompt|api\s*key|secret|credential)",
    r"(fabricate|invent|fake).{0,16}(citation|reference|source)",
)
PRONOUN_ONLY = r"(这个|那个|它|上述|前者|后者)(效果|方法|过程|结果)?(怎么样|如何|是什么|为什么|呢)?[？?]?"
VAGUE = r"(处理效果|处理性能|这个方法|这种方法|这个技术|这种技术|效果|效率|性能|限制|机理)"
GUARD_ANCHOR = r"(PFAS|PFOA|PFOS|AOP|PMS|PDS|臭氧|光催化|Fenton|芬顿|膜|吸附|催化剂|污染物|废水|饮用水|DOM|NOM|抗生素|双酚|活性炭)"
EXACT_VALUE = r"(具体数值|精确数值|准确数值|确切数值|多少\s*(mg|g|mol|%|℃|°C|分钟|小时)|去除率是多少|最佳浓度|最佳剂量|精确实验条件)"
NUMERIC_EVIDENCE = r"\d+(?:\.\d+)?\s*(?:%|mg/?L|g/?L|mol/?L|mmol/?L|µg/?L|μg/?L|℃|°C|min|h|分钟|小时)"
METRICS = (
    ("pH", r"\bph\b"),
    ("removal", r"(removal|degradation|mineralization)\s*(rate|efficiency)?|去除率|降解率|矿化率"),
    ("dosage", r"(dosage|dose|投加量|剂量)"),
    ("capacity", r"(adsorption\s*capacity|uptake\s*capacity|吸附容量)"),
    ("concentration", r"(concentration|浓度)"),
    ("time", r"(reaction\s*time|contact\s*time|反应时间|接触时间)"),
    ("flux", r"\bflux\b|通量"),
    ("rate", r"\b(rate|constant)\b|速率|常数"),
)
VALUE_REQUEST = r"(是多少|是什么|多少|what is|what's|how much|how many|最佳|最优|optimum|optimal|maximum|minimum|最高|最低)"
VERIFY_NUMBER = r"(是不是|是否|是不是证明|是否证明|does .{0,50}(?:prove|show|report|reach)|is it (?:true|correct))"
VERIFY = r"(是不是|是否|是不是证明|是否证明|是否达到|是不是达到|does .{0,50}(?:prove|show|report|reach)|is it (?:true|correct)|did .{0,40}(?:prove|show|report|reach))"
WHICH_BEST = r"(哪种|哪个|哪一种|哪些|which .{0,30}(?:is|are) (?:the )?(?:best|better|optimal)|what is the best)"
UNDERSPECIFIED = r"(效果如何|效果怎么样|好不好|行不行|是否有效|管用吗|does it work|is .{0,20} (?:effective|good|better|useful))"
EXHAUSTIVE = r"(所有|全部|完整|全面|完整对比|所有.{0,6}(?:工艺|方法|技术|材料)|complete|comprehensive|all (?:of )?(?:the )?(?:aop|method|technology|material|process)|full comparison)"
SUPERLATIVE_CLAIM = r"(最(?:稳定|好|高|强|有效|大|快|优)|most (?:stable|effective|efficient|optimal))"
SUPERLATIVE_DENIAL = r"(minimum|least|lowest|poorest|最不|最低|最小|最差|稳定性最低)"
DOMAIN_ANCHOR = (
    r"(pfas|pfoa|pfos|aop|pms|pds|ozone|臭氧|photocatal|光催化|fenton|芬顿|membrane|膜|adsorption|吸附|activated carbon|活性炭|catalyst|催化|pollutant|contaminant|污染物|"
    r"wastewater|废水|drinking water|饮用水|dom|nom|antibiotic|抗生素|bisphenol|双酚|sludge|污泥|biological|生物|coagul|絮凝|混凝|disinfect|消毒|electro|电化学|电絮凝|"
    r"nitrogen|氮|phosphorus|磷|microplastic|微塑料|water treatment|水处理|oxidation|氧化|高级氧化|工艺|再生|降解|去除|水质|污水)"
)
CITATION = r"(?i)\[S(\d+)\]"
EVIDENCE_CLAIM = "(文献证明|文献显示|研究证明|研究表明|根据文献|证据表明)"
BIBLIOGRAPHIC = r"(?:\b[A-Z][A-Za-z-]+\s+et\s+al\.?|[\x{4e00}-\x{9fff}]{2,4}等[（(]\d{4}[）)]|《[^》]{2,80}》)"
PAGE_UNVERIFIED = "[页码无法核验]"
NO_EVIDENCE_PHRASE = "没有足够证据"


def has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}")


def guardrail(question: Column) -> Column:
    """prompt_injection, needs_clarification or null."""

    def rule(q: Column) -> Column:
        injected = F.lit(False)
        for p in INJECTION:
            injected = injected | has(q, p)
        vague = (F.length(q) <= 24) & q.rlike(VAGUE) & ~has(q, GUARD_ANCHOR)
        return F.when(injected, "prompt_injection").when(q.rlike(f"^{PRONOUN_ONLY}$") | vague, "needs_clarification")

    return let(collapsed(F.coalesce(question, F.lit(""))), rule)


def combined(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x: F.coalesce(x, F.lit(""))), "\n")


def evidence_status(question: Column, texts: Column, best_distance: Column, most: float = MAX_DISTANCE) -> Column:
    lacking = has(question, EXACT_VALUE) & ~has(combined(texts), NUMERIC_EVIDENCE)
    return F.when((F.size(texts) == 0) | lacking | (best_distance > most), "insufficient").otherwise("available")


def metric_of(question: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(METRICS):
        out = F.when(has(question, pattern), name).otherwise(out)
    return out


def _near(pattern: str) -> str:
    """A digit within 70 characters of the pattern."""
    return rf"(?is)(?:{pattern}).{{0,69}}\d|\d.{{0,69}}(?:{pattern})"


def metric_number_in(metric: Column, text: Column) -> Column:
    out = F.lit(False)
    for name, pattern in METRICS:
        out = F.when(metric == name, text.rlike(_near(pattern))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def support(question: Column, texts: Column) -> Column:
    """Struct of status and reason."""
    metric = metric_of(question)
    near = F.exists(texts, lambda t: metric_number_in(metric, F.coalesce(t, F.lit(""))))

    def result(status: str, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    asks = metric.isNotNull() & has(question, VALUE_REQUEST)
    return (
        F.when(F.size(texts) == 0, result("unsupported", F.lit("no_retrieved_evidence")))
        .when(asks & near, result("supported", F.concat(metric, F.lit("_value_present"))))
        .when(asks, result("unsupported", F.concat(F.lit("no_"), metric, F.lit("_value_in_evidence"))))
        .when(has(question, WHICH_BEST), result("partial", F.lit("no_comparison_scope")))
        .otherwise(result("supported", F.lit("")))
    )


def _numbers_near(pattern: str, text: Column) -> Column:
    """Numbers in the 70 characters before and behind each mention."""
    around = F.regexp_extract_all(text, F.lit(rf"(?is)(.{{0,70}}(?:{pattern}).{{0,70}})"), F.lit(1))
    return F.flatten(F.transform(around, numbers))


def _has_other(pattern: str, claimed: Column):
    return lambda text: F.size(F.array_except(_numbers_near(pattern, F.coalesce(text, F.lit(""))), claimed)) > 0


def contradicted(question: Column, texts: Column) -> Column:
    """A verification question claims a number that the evidence doesn't have (near its metric, if it names one)."""
    claimed = numbers(question)
    metric = metric_of(question)
    near = F.lit(False)
    for name, pattern in METRICS:
        near = F.when(metric == name, F.exists(texts, _has_other(pattern, claimed))).otherwise(near)
    every = F.flatten(F.transform(texts, numbers))
    loose = (F.size(every) > 0) & (F.size(F.array_except(claimed, every)) > 0)
    return has(question, VERIFY_NUMBER) & (F.size(claimed) > 0) & F.coalesce(F.when(metric.isNotNull(), near).otherwise(loose), F.lit(False))


def false_premise(question: Column, texts: Column) -> Column:
    denied = has(question, SUPERLATIVE_CLAIM) & has(F.array_join(F.transform(texts, lambda x: F.coalesce(x, F.lit(""))), " "), SUPERLATIVE_DENIAL)
    return has(question, VERIFY) & (contradicted(question, texts) | denied)


def ambiguous(question: Column) -> Column:
    return has(question, WHICH_BEST) | ((F.length(collapsed(question)) <= 30) & has(question, UNDERSPECIFIED))


def partial(question: Column) -> Column:
    return has(question, EXHAUSTIVE)


def out_of_scope(question: Column) -> Column:
    return ~has(question, DOMAIN_ANCHOR)


def action(question: Column, texts: Column, status: Column, best_distance: Column, most: float = MAX_DISTANCE) -> Column:
    """Struct of action and reason; conflicts are never routed by rule."""
    found = support(question, texts)

    def result(a: str, reason) -> Column:
        return F.struct(F.lit(a).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    return (
        F.when(status == "insufficient", result("refuse", "insufficient_evidence"))
        .when(F.size(texts) == 0, result("refuse", "no_retrieved_evidence"))
        .when(best_distance > most, result("refuse", "distance_above_threshold"))
        .when(false_premise(question, texts), result("correct_premise", "verification_claim_unsupported_by_evidence"))
        .when(ambiguous(question), result("clarify", "ambiguous_or_underspecified_query"))
        .when(partial(question), result("partial_answer", "exhaustive_request_but_limited_evidence"))
        .when(found["status"] == "unsupported", result("refuse", F.concat(F.lit("claim_unsupported:"), found["reason"])))
        .otherwise(result("answer", ""))
    )


def cited_ids(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


#: What a footer says of an answer, in order.
WARNINGS = (
    "已移除无法映射到检索片段的越界引用。", "已标记无法映射到本次来源元数据的页码。", "已移除声称有文献支持但没有引用的句子。",
    "检测到元数据未必能够核验的作者或标题格式。", "回答没有任何可映射引用。", "模型输出达到长度上限，回答可能不完整。",
)
FOOTER = "\n\n> 引用校验："


def with_footer(v: Column) -> Column:
    """A validated answer as it's shown: warnings follow one that didn't pass."""
    footer = F.concat(F.regexp_replace(v["answer"], r"(?U)\s+$", ""), F.lit(FOOTER), F.array_join(v["warnings"], " "))
    return F.when((v["status"] != "passed") & (F.size(v["warnings"]) > 0), footer).otherwise(v["answer"])


def validated(answer: Column, n_contexts: Column, pages: Column, truncated: Column | None = None) -> Column:
    """Struct: corrected answer without footer, status, sorted used, unused, invalid ids, unsupported pages, removed claims, warnings.

    An answer that was cut off (``truncated``) fails.
    """
    cut = F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False))
    allowed = F.when(n_contexts > 0, F.sequence(F.lit(1), n_contexts)).otherwise(F.array().cast("array<int>"))
    invalid = F.array_sort(F.array_except(F.array_distinct(cited_ids(answer)), allowed))
    kept = F.aggregate(invalid, answer, lambda t, i: F.regexp_replace(t, F.concat(F.lit(r"(?i)\[S0*"), i.cast("string"), F.lit(r"\]")), F.lit("")))
    upper = F.when(F.size(invalid) > 0, F.regexp_replace(kept, r"\[s(\d+)\]", "[S$1]")).otherwise(answer)

    def rest(text: Column) -> Column:
        named = F.regexp_extract_all(text, F.lit(r"(?i)第\s*(\d+)\s*页|\bpage\s*(\d+)\b"), F.lit(0))
        found = F.transform(named, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))
        bad = F.array_sort(F.array_distinct(F.array_except(found, F.coalesce(pages, F.array().cast("array<int>")))))
        marked = F.aggregate(bad, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)第\s*0*"), p.cast("string"), F.lit(r"\s*页|\bpage\s*0*"), p.cast("string"), F.lit(r"\b")), F.lit(PAGE_UNVERIFIED)))
        parts = F.filter(F.split(marked, r"(?<=[。！？!?])|(?<=\n)"), lambda x: x != "")
        claims = lambda x: x.rlike(EVIDENCE_CLAIM) & ~x.rlike(CITATION)
        removed = F.size(F.filter(parts, claims))
        clean = F.when(removed > 0, F.regexp_replace(F.array_join(F.filter(parts, lambda x: ~claims(x)), ""), r"(?U)^\s+|\s+$", "")).otherwise(marked)
        used = F.array_sort(F.array_intersect(F.array_distinct(cited_ids(clean)), allowed))
        silent = (n_contexts > 0) & (F.size(used) == 0) & ~clean.contains(NO_EVIDENCE_PHRASE)
        failed = silent | clean.rlike(BIBLIOGRAPHIC) | cut
        told = (F.size(invalid) > 0, F.size(bad) > 0, removed > 0, clean.rlike(BIBLIOGRAPHIC), silent, cut)
        status = F.when(failed, "failed").when((F.size(invalid) > 0) | (F.size(bad) > 0) | (removed > 0), "corrected").otherwise("passed")
        return F.struct(
            clean.alias("answer"), status.alias("status"), used.alias("used"), F.array_sort(F.array_except(allowed, used)).alias("unused"),
            invalid.alias("invalid"), bad.alias("unsupported_pages"), removed.alias("removed_claims"),
            F.array_compact(F.array(*(F.when(when, F.lit(w)) for when, w in zip(told, WARNINGS, strict=True)))).alias("warnings"),
        )

    return let(upper, rest)


def claim_support(predicted: Column, answer: Column, gold: Column, contexts: Column) -> Column:
    ids = cited_ids(answer)
    wanted = evidence_norm(F.coalesce(gold, F.lit("")))
    holds = F.exists(ids, lambda i: F.coalesce(evidence_norm(F.try_element_at(contexts, F.when(i > 0, i))).contains(wanted), F.lit(False)))
    return (
        F.when(predicted != "answer", "NO_CLAIM").when(F.size(ids) == 0, "NO_CITATION").when(wanted == "", "NO_GOLD").when(holds, "SUPPORTED").otherwise("UNSUPPORTED")
    )


def predicted_action(found: Column, answer: Column) -> Column:
    """An answer that says there isn't enough evidence is a refusal."""
    return F.when((found == "answer") & F.coalesce(answer, F.lit("")).contains(NO_EVIDENCE_PHRASE), "refuse").otherwise(found)


def retriable(kind: Column, status: Column) -> Column:
    return kind.isin("connection", "timeout", "rate_limit") | F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(False))


def relevance_band(distance: Column) -> Column:
    return F.when(distance <= 0.6, "High").when(distance <= 1.0, "Medium").otherwise("Low")
