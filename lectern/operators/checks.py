"""Checks and accounts: of evaluation sets, indexes, manifests, requests and candidate lists. Violations are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import evidence_norm

# The action that each class of case expects, classes without gold, sections outside the index, the stages of a
# request, the folding of actions, topics by pattern, review titles, and the buckets of years.
CLASS_ACTION = {
    "ANSWERABLE": "answer", "PARTIAL": "partial_answer", "NO_EVIDENCE": "refuse", "AMBIGUOUS": "clarify", "FALSE_PREMISE": "correct_premise", "CONFLICT": "present_conflict",
}
NO_GOLD = ("NO_EVIDENCE", "AMBIGUOUS")
SPLITS = ("dev", "test")
EXCLUDED = ("references", "acknowledgments")
LOCAL_STAGES = (
    "request_parse_ms", "query_rewrite_ms", "query_embedding_ms", "chroma_search_ms", "filter_diversify_ms", "prompt_build_ms", "llm_client_prepare_ms", "citation_organize_ms",
)
MODEL_STAGE = "llm_full_generation_ms"
FOLDED = {"partial_answer": "answer", "correct_premise": "answer", "present_conflict": "answer"}
TOPICS = (
    ("advanced_oxidation_processes", r"(?i)persulfate|peroxymonosulfate|peroxydisulfate|percarbonate|pms|pds|fenton|ozone|ozonation|o3|uv[-_/ ]?h2o2|uv-h2o2|photocatal|photodegrad|advanced oxidation|高级氧化|过硫酸|臭氧|芬顿|光催化|高铁酸钾|催化氧化"),
    ("adsorption_ion_exchange", r"(?i)adsorption|adsorb|activated carbon|活性炭|吸附|再生|regeneration|biochar|水热炭|离子交换|ion exchange"),
    ("emerging_contaminants", r"(?i)pfas|pfoa|pfos|全氟|micropollutant|新污染物|emerging contaminant|ppcp|抗生素|antibiotic|嗅味|odor|磺胺|sulfamethoxazole|双酚|bisphenol|微污染物"),
    ("membrane_treatment", r"(?i)membrane|膜|超滤|ultrafiltration|陶瓷膜|ceramic"),
    ("disinfection", r"(?i)disinfect|chlorine|余氯|chloramine|消毒|氯"),
    ("industrial_wastewater", r"(?i)工业废水|industrial wastewater|喷漆|洗漆|渗滤液|leachate|纺织|制药废水"),
    ("biological_treatment", r"(?i)活性污泥|硝化|反硝化|厌氧消化|生物膜|颗粒污泥|activated sludge|anammox"),
    ("coagulation_flocculation", r"(?i)混凝|絮凝|沉淀|coagul|floccul"),
    ("electrochemical_treatment", r"(?i)电化学|电絮凝|电氧化|electrochem|electrocoagul|capacitive"),
    ("sludge_resource_recovery", r"(?i)污泥|sludge|磷回收|phosphorus recovery"),
)
YEARS = (("<2010", 2010), ("2010-2014", 2015), ("2015-2019", 2020), ("2020-2022", 2023))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def case_violations(cases: DataFrame, page_texts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """case_id, rule of what is wrong with evaluation cases.

    ``cases``: case_id, class, expected, split, paired_with, gold, paper_id, page; ``page_texts``: case_id, text of the gold
    pages; ``used``: paper_ids of earlier sets, which gold papers must not come from.
    """
    held = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    known, bare = F.col("class").isin(*CLASS_ACTION), F.col("class").isin(*NO_GOLD)
    wanted = F.create_map(*(F.lit(x) for pair in CLASS_ACTION.items() for x in pair))
    by_row = (
        ("bad class", ~F.coalesce(known, F.lit(False))), ("bad action", known & (F.try_element_at(wanted, F.col("class")) != F.col("expected"))), ("bad split", ~F.col("split").isin(*SPLITS)),
        ("gold not allowed", bare & (held("gold") | held("paper_id"))), ("gold missing", known & ~bare & (~held("gold") | ~held("paper_id") | F.col("page").isNull())),
    )
    rules = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.lit(rule)) for rule, when in by_row))))
    ids = cases.select(F.col("case_id").alias("paired_with"), F.col("class").alias("_class"))
    paired = cases.filter(held("paired_with")).select("case_id", "paired_with").join(ids, "paired_with", "left")
    texts = cases.filter(known & ~bare & held("gold")).select("case_id", "gold").join(page_texts, "case_id", "left")
    lost = ~F.coalesce(evidence_norm(F.col("text")).contains(evidence_norm(F.col("gold"))), F.lit(False))
    parts = [
        cases.select("case_id", rules.alias("rule")),
        cases.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("duplicate id").alias("rule")),
        paired.filter("_class is null").select("case_id", F.lit("pair not found").alias("rule")),
        paired.filter("_class <> 'ANSWERABLE'").select("case_id", F.lit("pair not answerable").alias("rule")),
        texts.filter(lost).select("case_id", F.lit("gold not on its pages").alias("rule")),
    ]
    if used is not None:
        parts.append(cases.join(used.select("paper_id").distinct(), "paper_id", "left_semi").select("case_id", F.lit("paper not fresh").alias("rule")))
    return _all(parts).distinct()


def index_checks(dense: DataFrame, sparse: DataFrame, papers: DataFrame, wanted: int) -> DataFrame:
    """check, found, passed of an index: as many chunks in both parts, none from excluded sections, the papers it should cover.

    ``dense``: id, paper_id, section; ``sparse``: id; ``papers``: paper_id of the other index, or of the corpus.
    """
    count = lambda df: df.agg(F.count("*").alias("n"))
    mine, theirs = dense.select("paper_id").distinct(), papers.select("paper_id").distinct()
    leaked = F.lower(F.trim(F.coalesce("section", F.lit("")))).isin(*EXCLUDED)
    found = {
        "chunks in one part only": count(dense.select("id").exceptAll(sparse.select("id").distinct()).union(sparse.select("id").distinct().exceptAll(dense.select("id")))),
        "excluded sections": count(dense.filter(leaked)), "papers in one index only": count(mine.exceptAll(theirs).union(theirs.exceptAll(mine))),
        "papers too many or too few": count(mine).select(F.abs(F.col("n") - wanted).alias("n")),
    }
    rows = _all([df.select(F.lit(check).alias("check"), F.col("n").alias("found")) for check, df in found.items()])
    return rows.withColumn("passed", F.col("found") == 0)


def manifest_checks(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row of a manifest (sha256, doi, resolution, final_file) against the files (name) that are there."""
    dois = manifest.filter("doi <> ''").groupBy("doi").count().filter("count > 1").agg(F.count("*").alias("duplicate_dois"))
    missing = manifest.join(files.select(F.col("name").alias("final_file")), "final_file", "left_anti").agg(F.count("*").alias("missing_files"))
    kinds = manifest.groupBy("resolution").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("resolution", "count")))).alias("resolutions"))
    rows = manifest.agg(F.count("*").alias("rows"), F.countDistinct("sha256").alias("distinct_sha"), F.count_if(F.coalesce("sha256", F.lit("")) == "").alias("empty_sha"))
    return rows.crossJoin(dois).crossJoin(missing).crossJoin(kinds.select(F.to_json("resolutions").alias("resolutions")))


def request_times(stages: DataFrame, wall_ms: str = "wall_ms") -> DataFrame:
    """trace_id, total_ms, local_processing_ms, external_model_ms of requests; stages that weren't timed count nothing."""
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in stages.columns else F.lit(0.0)
    local = reduce(Column.__add__, map(at, LOCAL_STAGES))
    return stages.select("trace_id", (at(wall_ms) + at("request_parse_ms")).alias("total_ms"), local.alias("local_processing_ms"), at(MODEL_STAGE).alias("external_model_ms"))


def score_panel(a: DataFrame, b: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """metric, v1_mean, v2_mean, delta of two runs with these columns."""
    mean = lambda df, name: df.agg(*(F.avg(x).alias(x) for x in scores)).unpivot([], list(scores), "metric", name)
    both = mean(a, "v1_mean").join(mean(b, "v2_mean"), "metric")
    return both.select("metric", F.round("v1_mean", 4).alias("v1_mean"), F.round("v2_mean", 4).alias("v2_mean"), F.round(F.col("v2_mean") - F.col("v1_mean"), 4).alias("delta"))


def folded_action(action: Column) -> Column:
    """Six actions as three: what answers in part or corrects is an answer."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FOLDED.items() for x in pair)), action), action)


def class_accuracy(rows: DataFrame) -> DataFrame:
    """class, n, exact, folded: how often the predicted action is the expected one, as it is and folded."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    p, e = F.col("predicted"), F.col("expected")
    return rows.groupBy("class").agg(F.count("*").alias("n"), share(p == e).alias("exact"), share(folded_action(p) == folded_action(e)).alias("folded"))


def trust_counters(rows: DataFrame) -> DataFrame:
    """One row over (class, predicted, claim): answers that should be refusals, refusals that should be answers, and claims."""
    c, p, claim = F.col("class"), F.col("predicted"), F.col("claim")
    made = F.count_if(claim.isin("SUPPORTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED"))
    share = lambda n, of: F.round(n / F.greatest(F.lit(1), of), 4)
    return rows.agg(
        F.count_if(c.isin("AMBIGUOUS", "NO_EVIDENCE") & (p == "answer")).alias("answered_but_should_refuse"),
        F.count_if((c == "ANSWERABLE") & (p == "refuse")).alias("refused_but_should_answer"),
        F.count_if((c == "ANSWERABLE") & (p == "answer") & (claim == "UNSUPPORTED")).alias("near_evidence_masquerade"),
        share(F.count_if(claim == "UNSUPPORTED"), made).alias("unsupported_claim_rate"), share(F.count_if(claim == "SUPPORTED"), F.count_if(p == "answer")).alias("citation_support_rate"),
    )


def best_distance(hits: DataFrame) -> DataFrame:
    """query_id, best: the least distance of a query's hits, 999 where none has one."""
    return hits.groupBy("query_id").agg(F.coalesce(F.min("distance"), F.lit(999.0)).alias("best"))


def year_range(year: Column) -> Column:
    out = F.lit("2023-2026")
    for name, below in reversed(YEARS):
        out = F.when(F.coalesce(year, F.lit(0)) < below, name).otherwise(out)
    return out


def list_distributions(lists: DataFrame) -> DataFrame:
    """kind, name, n: how topics, years, types, access and reasons are spread over (list, topic, year, paper_type, access, reason)."""
    main = lists.filter("list in ('A', 'B', 'C')")
    count = lambda df, kind, c: df.groupBy(c.cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return _all([
        count(lists, "list", F.col("list")), count(main, "topic", F.col("topic")), count(lists.filter("list = 'reserve'"), "reserve topic", F.col("topic")),
        count(main, "year", year_range(F.col("year"))), count(main, "paper_type", F.col("paper_type")), count(main, "access", F.col("access")),
        count(lists.filter("list = 'rejected'"), "reason", F.col("reason")),
    ])


def known_dois(*lists: DataFrame) -> DataFrame:
    """The DOIs of several lists, lower case, each once."""
    return _all([x.select(F.lower(F.trim("doi")).alias("doi")) for x in lists]).filter("doi <> ''").distinct()
