"""Queries over checks, accounts and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import checks as K
from lectern.operators import corpus as C
from lectern.sources import reports as O

from . import adapters as A
from . import corpus as P
from . import evaluation as E
from . import inventory as I
from . import retrieval as R
from . import spans as S
from .registry import registry

QUERIES, ORACLES, query = registry()

_NORM = S._NORM
_CASES = f"""cs AS (SELECT CASE WHEN item_id % 40 = 39 THEN item_id - 1 ELSE item_id END AS case_id, CASE item_id % 8 WHEN 0 THEN 'NO_EVIDENCE' WHEN 1 THEN 'FALSE_PREMISE' WHEN 2 THEN 'OTHER' ELSE 'ANSWERABLE' END AS class,
  CASE item_id % 8 WHEN 0 THEN 'refuse' WHEN 1 THEN 'answer' ELSE 'answer' END AS expected, CASE WHEN item_id % 9 = 8 THEN 'train' ELSE 'dev' END AS split,
  CASE WHEN item_id % 10 = 3 THEN item_id + 1 WHEN item_id % 10 = 4 THEN 100000 END AS paired_with, CASE WHEN item_id % 8 = 0 AND item_id % 16 > 0 THEN '' WHEN item_id % 7 = 5 THEN NULL ELSE text END AS gold,
  CASE WHEN item_id % 8 = 0 THEN '' ELSE 'p' || (item_id % 50) END AS paper_id, CASE WHEN item_id % 11 < 10 THEN item_id % 8 END AS page, CASE WHEN item_id % 5 = 0 THEN 'another page' ELSE 'x  ' || upper(text) || ' y' END AS page_text, item_id FROM benchmark)"""


def cases(spark, d):
    i = F.col("item_id")
    kind = F.when(i % 8 == 0, "NO_EVIDENCE").when(i % 8 == 1, "FALSE_PREMISE").when(i % 8 == 2, "OTHER").otherwise("ANSWERABLE")
    return A.read(spark, d, "benchmark").select(
        F.when(i % 40 == 39, i - 1).otherwise(i).alias("case_id"), kind.alias("class"), F.when(i % 8 == 0, "refuse").otherwise("answer").alias("expected"),
        F.when(i % 9 == 8, "train").otherwise("dev").alias("split"), F.when(i % 10 == 3, i + 1).when(i % 10 == 4, 100000).cast("string").alias("paired_with"),
        F.when((i % 8 == 0) & (i % 16 > 0), "").when(i % 7 == 5, None).otherwise(F.col("text")).alias("gold"),
        F.when(i % 8 == 0, "").otherwise(F.concat(F.lit("p"), (i % 50).cast("string"))).alias("paper_id"), F.when(i % 11 < 10, i % 8).alias("page"),
        F.when(i % 5 == 0, "another page").otherwise(F.concat(F.lit("x  "), F.upper("text"), F.lit(" y"))).alias("page_text"),
    )


@query(f"""WITH {_CASES}, v AS (
SELECT case_id, 'bad class' AS rule FROM cs WHERE class = 'OTHER' UNION ALL SELECT case_id, 'bad action' FROM cs WHERE class = 'FALSE_PREMISE' UNION ALL SELECT case_id, 'bad split' FROM cs WHERE split = 'train'
UNION ALL SELECT case_id, 'gold not allowed' FROM cs WHERE class = 'NO_EVIDENCE' AND (coalesce(gold, '') <> '' OR paper_id <> '')
UNION ALL SELECT case_id, 'gold missing' FROM cs WHERE class IN ('FALSE_PREMISE', 'ANSWERABLE') AND (coalesce(gold, '') = '' OR paper_id = '' OR page IS NULL)
UNION ALL SELECT case_id, 'duplicate id' FROM cs GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT case_id, 'pair not found' FROM cs WHERE paired_with IS NOT NULL AND paired_with NOT IN (SELECT case_id FROM cs)
UNION ALL SELECT a.case_id, 'pair not answerable' FROM cs a JOIN cs b ON a.paired_with = b.case_id WHERE b.class <> 'ANSWERABLE'
UNION ALL SELECT a.case_id, 'gold not on its pages' FROM cs a JOIN cs b USING (case_id) WHERE a.class IN ('FALSE_PREMISE', 'ANSWERABLE') AND coalesce(a.gold, '') <> '' AND NOT contains({_NORM.format('b.page_text')}, {_NORM.format('a.gold')})
UNION ALL SELECT case_id, 'paper not fresh' FROM cs WHERE paper_id IN ('p1', 'p2', 'p3'))
SELECT DISTINCT case_id, rule FROM v""")
def case_checks(spark, d):
    rows = cases(spark, d).withColumn("case_id", F.col("case_id").cast("string"))
    used = A.values(spark, [("p1",), ("p2",), ("p3",)], "paper_id string")
    found = K.case_violations(rows.drop("page_text"), rows.select("case_id", F.col("page_text").alias("text")), used)
    return found.select(F.col("case_id").cast("long").alias("case_id"), "rule")


@query(f"""WITH {S._PLACED}, {R.INDEX}, sp AS (SELECT DISTINCT id FROM idx WHERE id % 13 <> 0), pp AS (SELECT DISTINCT paper_id FROM placed), oth AS (SELECT DISTINCT paper_id FROM placed WHERE id % 20 <> 7),
f AS (SELECT 'chunks in one part only' AS "check", (SELECT count(*) FROM placed WHERE id NOT IN (SELECT id FROM sp)) + (SELECT count(*) FROM sp WHERE id NOT IN (SELECT id FROM placed)) AS found
UNION ALL SELECT 'excluded sections', count(*) FROM placed WHERE section IN ('references', 'acknowledgments')
UNION ALL SELECT 'papers in one index only', (SELECT count(*) FROM pp WHERE paper_id NOT IN (SELECT paper_id FROM oth)) UNION ALL SELECT 'papers too many or too few', abs((SELECT count(*) FROM pp) - 270))
SELECT "check", found, found = 0 AS passed FROM f""")
def index_verify(spark, d):
    dense = S.placed(spark, d).select("id", "paper_id", "section")
    sparse = R.R.sparse_index(R.chunks(spark, d)).filter("id % 13 <> 0").select("id").distinct()
    return K.index_checks(dense, sparse, S.placed(spark, d).filter("id % 20 <> 7"), 270)


@query(f"""WITH {I._RECORDS}, m AS (SELECT sha256, doi, CASE WHEN doi <> '' THEN 'unique_doi' ELSE 'unresolved' END AS resolution, id || '.pdf' AS final_file, id FROM rec)
SELECT count(*) AS rows, count(DISTINCT sha256) AS distinct_sha, 0 AS empty_sha, (SELECT count(*) FROM (SELECT doi FROM m WHERE doi <> '' GROUP BY 1 HAVING count(*) > 1)) AS duplicate_dois,
count(*) FILTER (WHERE id % 50 = 0) AS missing_files, '{{"unique_doi":' || count(*) FILTER (WHERE doi <> '') || ',"unresolved":' || count(*) FILTER (WHERE doi = '') || '}}' AS resolutions FROM m""")
def manifest_verify(spark, d):
    rows = I.records(spark, d).select("id", "sha256", "doi", F.when(F.col("doi") != "", "unique_doi").otherwise("unresolved").alias("resolution"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("final_file"))
    return K.manifest_checks(rows, rows.filter("id % 50 <> 0").select(F.col("final_file").alias("name")))


@query("""SELECT event_id AS trace_id, value + event_id % 7 AS total_ms, (event_id % 7 + coalesce(CASE WHEN event_id % 3 > 0 THEN user_id END, 0))::DOUBLE AS local_processing_ms, CASE WHEN event_id % 5 > 0 THEN value * 10 ELSE 0 END AS external_model_ms FROM events""")
def request_times(spark, d):
    e = F.col("event_id")
    rows = A.read(spark, d, "events").select(e.alias("trace_id"), F.col("value").alias("wall_ms"), (e % 7).alias("request_parse_ms"), F.when(e % 3 > 0, F.col("user_id")).alias("chroma_search_ms"), F.when(e % 5 > 0, F.col("value") * 10).alias("llm_full_generation_ms"))
    return K.request_times(rows)


_MEANS = " UNION ALL ".join(f"SELECT '{x}' AS metric, avg({x}) FILTER (WHERE judged) AS a, avg(CASE WHEN judged THEN {x} + doc_id % 2 END) AS b FROM rs" for x in ("faithfulness", "completeness", "citation", "overall"))


@query(f"WITH {E._J}, m AS ({_MEANS}) SELECT metric, round(a, 4) AS v1_mean, round(b, 4) AS v2_mean, round(b - a, 4) AS delta FROM m")
def score_panels(spark, d):
    scores = ("faithfulness", "completeness", "citation", "overall")
    rows = E.results(spark, d).filter("judge is not null")
    return K.score_panel(rows.select(*(f"judge.{x}" for x in scores)), rows.select(*((F.col(f"judge.{x}") + F.col("doc_id") % 2).alias(x) for x in scores)), scores)


_FOLD = "CASE WHEN {0} IN ('partial_answer', 'correct_premise', 'present_conflict') THEN 'answer' ELSE {0} END"


@query(f"WITH {E.BEHAVIOUR} SELECT class, count(*) AS n, round(avg((predicted = expected)::INT), 4) AS exact, round(avg(({_FOLD.format('predicted')} = {_FOLD.format('expected')})::INT), 4) AS folded FROM bh GROUP BY 1")
def class_accuracy(spark, d):
    return K.class_accuracy(E.behaviours(spark, d))


_CLAIM = "CASE WHEN predicted <> 'answer' THEN 'NO_CLAIM' WHEN n_used = 0 THEN 'NO_CITATION' WHEN status = 'passed' THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END"


@query(f"""WITH {E.BEHAVIOUR}, c AS (SELECT *, {_CLAIM} AS claim FROM bh) SELECT count(*) FILTER (WHERE class IN ('AMBIGUOUS', 'NO_EVIDENCE') AND predicted = 'answer') AS answered_but_should_refuse,
count(*) FILTER (WHERE class = 'ANSWERABLE' AND predicted = 'refuse') AS refused_but_should_answer, count(*) FILTER (WHERE class = 'ANSWERABLE' AND predicted = 'answer' AND claim = 'UNSUPPORTED') AS near_evidence_masquerade,
round(count(*) FILTER (WHERE claim = 'UNSUPPORTED') / greatest(1, count(*) FILTER (WHERE claim IN ('SUPPORTED', 'UNSUPPORTED'))), 4) AS unsupported_claim_rate,
round(count(*) FILTER (WHERE claim = 'SUPPORTED') / greatest(1, count(*) FILTER (WHERE predicted = 'answer')), 4) AS citation_support_rate FROM c""")
def trust_counters(spark, d):
    claim = F.when(F.col("predicted") != "answer", "NO_CLAIM").when(F.col("n_used") == 0, "NO_CITATION").when(F.col("status") == "passed", "SUPPORTED").otherwise("UNSUPPORTED")
    return K.trust_counters(E.behaviours(spark, d).withColumn("claim", claim))


@query(f"WITH {R.FUSED} SELECT query_id, coalesce(min(distance), 999) AS best FROM fused GROUP BY 1")
def best_distances(spark, d):
    return K.best_distance(R.R.rrf(R.dense(spark, d), R.sparse(spark, d)))


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(t, {A.q(p)}) THEN '{n}'" for n, p in K.TOPICS) + " ELSE 'other' END"


@query(f"""WITH {I._FIRST}, t AS (SELECT doc_id, source || ' ' || meta || ' ' || left(first, 400) AS t FROM fp) SELECT doc_id, {_TOPIC} AS topic FROM t""")
def paper_topics(spark, d):
    """The first of ten topics that a paper's name, title or beginning speaks of."""
    rows = I.papers(spark, d).select("doc_id", F.concat_ws(" ", "source", "meta", F.substring("first", 1, 400)).alias("t"))
    return rows.select("doc_id", C.first_rule(F.col("t"), list(K.TOPICS)).alias("topic"))


_RANGE = "CASE " + " ".join(f"WHEN year < {b} THEN '{n}'" for n, b in K.YEARS) + " ELSE '2023-2026' END"


@query(f"""WITH {P.CAND}, l AS (SELECT CASE id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'reserve' ELSE 'rejected' END AS list, topic, year, CASE WHEN review THEN 'review' ELSE 'original_research' END AS paper_type,
  CASE WHEN id % 3 = 0 THEN 'open_access' ELSE 'unknown' END AS access, CASE WHEN id % 2 = 0 THEN 'quota_exceeded' ELSE 'duplicate_of_existing_corpus' END AS reason FROM sc),
m AS (SELECT * FROM l WHERE list IN ('A', 'B', 'C'))
SELECT 'list' AS kind, list AS name, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'topic', topic, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'reserve topic', topic, count(*) FROM l WHERE list = 'reserve' GROUP BY 2
UNION ALL SELECT 'year', {_RANGE}, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'paper_type', paper_type, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'access', access, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'reason', reason, count(*) FROM l WHERE list = 'rejected' GROUP BY 2""")
def list_distributions(spark, d):
    i = F.col("id")
    k = i % 5
    rows = P.scored(spark, d).select(
        F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "reserve").otherwise("rejected").alias("list"), "topic", "year", F.when(F.col("review"), "review").otherwise("original_research").alias("paper_type"),
        F.when(i % 3 == 0, "open_access").otherwise("unknown").alias("access"), F.when(i % 2 == 0, "quota_exceeded").otherwise("duplicate_of_existing_corpus").alias("reason"),
    )
    return K.list_distributions(rows)


@query(f"WITH {P.CAND} SELECT DISTINCT '10.1/' || (id % 900) AS doi FROM cd WHERE id % 2 = 0 OR id % 3 = 0")
def doi_union(spark, d):
    rows = P.candidates(spark, d).select("id", F.concat(F.lit(" 10.1/"), (F.col("id") % 900).cast("string")).alias("doi"))
    return K.known_dois(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0").withColumn("doi", F.upper("doi")))


@query(f"""WITH {S._PLACED}, c AS (SELECT section, count(*) AS n, count(*) FILTER (WHERE id % 6 = 0) AS n_fallback, count(DISTINCT paper_id) AS n_papers FROM placed GROUP BY 1)
SELECT section, n, round(n / sum(n) OVER (), 6) AS share, n_fallback, n_papers FROM c""")
def chunk_sections(spark, d):
    mode = F.when(F.col("id") % 6 == 0, "fallback_fixed").otherwise("section_aware")
    return O.chunk_statistics(S.placed(spark, d).withColumn("chunking_mode", mode))
