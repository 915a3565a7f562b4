"""Queries over gold spans, pages, sections and the retrieval metrics and gate that rest on them.

The benchmark's items are the gold spans; four documents in a row make a paper, each with its pages and its section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import metrics as M
from lectern.operators import spans as S
from lectern.sources.places import written

from . import adapters as A
from . import evaluation as E
from . import retrieval as R
from .registry import registry

QUERIES, ORACLES, query = registry()

SECTIONS = ("front_matter", "methods", "results", "references")
_NORM = r"replace(lower(regexp_replace(regexp_replace({0}, '[‐‑‒–—−]', '-', 'g'), '\s+', ' ', 'g')), 'ß', 'ss')"
_PLACED = f"""placed AS (SELECT doc_id AS id, 'p' || (doc_id // 4) AS paper_id, source, 1 + (doc_id % 4) * 2 AS page_start,
  1 + (doc_id % 4) * 2 + doc_id % 2 AS page_end, {A.sql_list(SECTIONS)}[doc_id % 4 + 1] AS section, text FROM documents)"""
_GOLD = f"""bg AS (SELECT item_id AS case_id, text AS gold, {_NORM.format("text")} AS g, item_id % 8 + 1 AS page FROM benchmark),
dt AS MATERIALIZED (SELECT doc_id AS id, {_NORM.format("text")} AS t FROM documents),
held AS MATERIALIZED (SELECT case_id, id FROM bg JOIN dt ON contains(t, g) WHERE g <> ''),
gf AS (SELECT case_id, min(id) AS id, count(*) AS n_places FROM held GROUP BY 1),
gold AS MATERIALIZED (SELECT case_id, id, n_places FROM bg LEFT JOIN gf USING (case_id)),
{_PLACED},
gp AS MATERIALIZED (SELECT g.case_id, p.paper_id, p.page_start AS page, b.gold FROM gold g JOIN placed p ON p.id = g.id JOIN bg b ON b.case_id = g.case_id)"""


def _hits_sql(name: str, of: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT query_id AS case_id, rank + 1 AS rank, paper_id, page_start, page_end, source, text
  FROM {of} JOIN placed USING (id) WHERE rank < 10)"""


_RANKED = f"""{_GOLD}, {R.SPARSE}, {_hits_sql('hits10', 'sparse')},
pr AS (SELECT g.case_id, min(h.rank) AS paper_rank, min(CASE WHEN g.page BETWEEN h.page_start AND h.page_end THEN h.rank END) AS page_rank
  FROM gp g LEFT JOIN hits10 h ON h.case_id = g.case_id AND h.paper_id = g.paper_id GROUP BY 1),
sp AS (SELECT g.case_id, min(CASE WHEN contains({_NORM.format('h.text')}, {_NORM.format('g.gold')}) THEN h.rank END) AS span_rank
  FROM gp g LEFT JOIN hits10 h USING (case_id) GROUP BY 1),
rk AS MATERIALIZED (SELECT * FROM pr JOIN sp USING (case_id))"""
_METRICS = """SELECT count(*) AS n, round(avg(coalesce((paper_rank <= 5)::INT, 0)), 4) AS recall5, round(avg(coalesce((paper_rank <= 10)::INT, 0)), 4) AS recall10,
round(avg(CASE WHEN paper_rank <= 10 THEN 1 / paper_rank ELSE 0 END), 4) AS mrr10,
round(avg(coalesce((page_rank <= 5)::INT, 0)), 4) AS page_hit5, round(avg(coalesce((page_rank <= 10)::INT, 0)), 4) AS page_hit10,
round(avg(coalesce((span_rank <= 5)::INT, 0)), 4) AS span_hit5, round(avg(coalesce((span_rank <= 10)::INT, 0)), 4) AS span_hit10 FROM rk"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("gold"), (F.col("item_id") % 8 + 1).alias("page"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    first = 1 + (i % 4) * 2
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (i % 4 + 1).cast("int"))
    return A.read(spark, d, "documents").select(
        i.alias("id"), F.concat(F.lit("p"), F.floor(i / 4)).alias("paper_id"), "source", first.alias("page_start"), (first + i % 2).alias("page_end"), section.alias("section"), "text"
    )


def gold(spark, d) -> DataFrame:
    return S.located(cases(spark, d).drop("page"), placed(spark, d).select("id", "text"))


def gold_papers(spark, d) -> DataFrame:
    """case_id, paper_id, page, gold of the cases whose span stands somewhere."""
    rows = gold(spark, d).filter("id is not null").select("case_id", "id")
    rows = rows.join(placed(spark, d).select("id", "paper_id", F.col("page_start").alias("page")), "id").join(cases(spark, d).select("case_id", "gold"), "case_id").drop("id")
    return written(rows, "gold")  # a row a case, read several times


def hits(spark, d, found: DataFrame | None = None) -> DataFrame:
    """The first ten hits of each case; other queries are left out before texts are fetched, which are read several times."""
    found = R.sparse(spark, d) if found is None else found
    asked = cases(spark, d).select(F.col("case_id").alias("query_id"))
    found = found.filter("rank < 10").select("query_id", "id", "rank").join(asked, "query_id", "left_semi")
    return written(S.ranked_hits(found).join(placed(spark, d), "id"), "hits")


def ranks(spark, d) -> DataFrame:
    g, h = gold_papers(spark, d), hits(spark, d)
    return S.page_hits(g, h).join(S.span_hits(g, h), "case_id")


@query(f"WITH {_GOLD} SELECT case_id, id, n_places FROM gold")
def gold_locate(spark, d):
    return gold(spark, d)


@query(f"""WITH {_GOLD}, o AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN page BETWEEN page_start AND page_end THEN 0 ELSE 1 END, id) AS n
  FROM held JOIN bg USING (case_id) JOIN placed USING (id)) SELECT case_id, o.id, gf.n_places FROM bg LEFT JOIN (SELECT * FROM o WHERE n = 1) o USING (case_id) LEFT JOIN gf USING (case_id)""")
def gold_page_hint(spark, d):
    return S.located(cases(spark, d), placed(spark, d))


@query(f"""WITH {_GOLD}, w AS (SELECT case_id, text, instr(lower(text), lower(gold)) AS a, length(gold) AS n FROM gold JOIN bg USING (case_id) JOIN documents ON doc_id = gold.id),
c AS (SELECT case_id, a, regexp_extract(substr(text, 1, a - 1), '[^{S.ENDS}]*$') AS x, substr(text, a, n) AS y, substr(text, a + n) AS z FROM w WHERE a > 0)
SELECT case_id, regexp_replace(regexp_replace(x || y || CASE WHEN regexp_matches(y, '[{S.ENDS}]$') THEN '' ELSE regexp_extract(z, '^[^{S.ENDS}]*[{S.ENDS}]?') END, '\\s+', ' ', 'g'),
  '^[{S.TRIMMED}]+|[{S.TRIMMED}]+$', '', 'g') AS evidence FROM c""")
def gold_window(spark, d):
    rows = gold(spark, d).join(cases(spark, d).select("case_id", "gold"), "case_id").join(placed(spark, d).select("id", "text"), "id")
    return rows.select("case_id", S.sentence_window(F.col("text"), F.col("gold")).alias("evidence")).filter("evidence is not null")


@query(f"""WITH {_GOLD} SELECT bg.case_id, CASE WHEN p.id IS NULL THEN 'NO_EVIDENCE' ELSE 'ANSWERABLE' END AS class, CASE WHEN p.id IS NULL THEN 'refuse' ELSE 'answer' END AS expected,
  coalesce(p.paper_id, '') AS gold_paper, p.page_start AS gold_page, coalesce(p.section, '') AS gold_section FROM bg JOIN gold USING (case_id) LEFT JOIN placed p ON p.id = gold.id""")
def case_defaults(spark, d):
    """What an evaluation case gets from the chunk that holds its span; cases without one are NO_EVIDENCE and have no gold."""
    rows = gold(spark, d).select("case_id", "id").join(placed(spark, d).select("id", "paper_id", "page_start", "section"), "id", "left")
    none = F.col("id").isNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "case_id", F.when(none, "NO_EVIDENCE").otherwise("ANSWERABLE").alias("class"), F.when(none, "refuse").otherwise("answer").alias("expected"),
        blank("paper_id").alias("gold_paper"), F.col("page_start").alias("gold_page"), blank("section").alias("gold_section"),
    )


@query(f"WITH {_RANKED} {_METRICS}")
def recall_mrr(spark, d):
    return S.retrieval_metrics(ranks(spark, d))


@query(f"WITH {_RANKED} SELECT case_id, paper_rank, coalesce(paper_rank <= 5, false) AS hit5, coalesce(paper_rank <= 10, false) AS hit10 FROM rk")
def hit_at_k(spark, d):
    within = lambda k: F.coalesce(F.col("paper_rank") <= k, F.lit(False))
    return ranks(spark, d).select("case_id", "paper_rank", within(5).alias("hit5"), within(10).alias("hit10"))


@query(f"WITH {_RANKED} SELECT case_id, page_rank, span_rank FROM rk")
def page_hit_range(spark, d):
    return ranks(spark, d).select("case_id", "page_rank", "span_rank")


@query(f"WITH {_PLACED}, e AS (SELECT paper_id, section, unnest(range(page_start, page_end + 1)) AS page FROM placed) SELECT paper_id, page, list_sort(list_distinct(list(section))) AS sections FROM e GROUP BY 1, 2")
def section_pages(spark, d):
    return S.section_map(placed(spark, d))


@query(f"""WITH {_RANKED}, sm AS (SELECT DISTINCT paper_id, unnest(range(page_start, page_end + 1)) AS page FROM placed WHERE section = 'references'),
h AS (SELECT g.case_id, h.rank, max((sm.page IS NOT NULL)::INT) AS listed FROM gp g JOIN hits10 h USING (case_id, paper_id) LEFT JOIN sm ON sm.paper_id = h.paper_id AND sm.page BETWEEN h.page_start AND h.page_end GROUP BY 1, 2),
c AS (SELECT case_id, count(*) AS n, sum(listed) AS m FROM h GROUP BY 1)
SELECT case_id, coalesce(n, 0) AS n_gold, coalesce(m, 0)::BIGINT AS n_references, round(coalesce(m, 0) / greatest(1, coalesce(n, 0)), 4) AS share FROM gp LEFT JOIN c USING (case_id)""")
def references_confound(spark, d):
    return S.references_share(gold_papers(spark, d), hits(spark, d), S.section_map(placed(spark, d)))


@query(f"""WITH {A.PLAIN_PAGES_SQL}, s AS (SELECT doc_id AS case_id, 'd' || doc_id AS paper_id, doc_id % 3 AS a, doc_id % 3 + 2 AS b FROM documents)
SELECT s.case_id, coalesce(string_agg(p.text, chr(10) ORDER BY p.page), '') AS text FROM s LEFT JOIN pages_in p ON p.paper_id = s.paper_id AND p.page BETWEEN s.a AND s.b GROUP BY 1""")
def page_range(spark, d):
    i = F.col("doc_id")
    wanted = A.read(spark, d, "documents").select(i.alias("case_id"), F.concat(F.lit("d"), i).alias("paper_id"), (i % 3).alias("page_start"), (i % 3 + 2).alias("page_end"))
    return S.page_range_text(wanted, A.plain_pages(spark, d).select("paper_id", "page", "text"))


_EXPECTED = """ex AS (SELECT item_id AS case_id, CASE WHEN item_id % 9 = 0 THEN [] ELSE ['p' || (item_id % 30), 'src' || (item_id % 4), 'src' || (item_id % 4)] END AS wanted FROM benchmark),
ew AS (SELECT case_id, unnest(list_distinct(wanted)) AS w FROM ex)"""


def expectations(spark, d):
    i = F.col("item_id")
    source = F.concat(F.lit("src"), i % 4)
    listed = F.array(F.concat(F.lit("p"), i % 30), source, source)
    return A.read(spark, d, "benchmark").select(i.alias("case_id"), F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(listed).alias("expected_sources"))


def _expected_sql(hits_name: str) -> str:
    return f"""SELECT x.case_id, len(list_distinct(wanted)) AS expected, coalesce(m, 0) AS matched, CASE WHEN len(wanted) > 0 THEN round(coalesce(m, 0) / len(list_distinct(wanted)), 6) ELSE 0 END AS recall,
  first_rank, coalesce(round(1 / first_rank, 6), 0) AS mrr FROM ex x LEFT JOIN (SELECT e.case_id, count(DISTINCT w) AS m, min(rank) AS first_rank FROM ew e JOIN {hits_name} h
  ON h.case_id = e.case_id AND (contains(h.source, w) OR contains(h.paper_id, w)) GROUP BY 1) USING (case_id)"""


@query(f"WITH {_EXPECTED}, {_PLACED}, {R.SPARSE}, {_hits_sql('hits10', 'sparse')} {_expected_sql('hits10')}")
def multi_gold_score(spark, d):
    return S.expected_sources(expectations(spark, d), hits(spark, d))


_MODES = f"""{_EXPECTED}, {_PLACED}, {R.DENSE}, {R.SPARSE}, {_hits_sql('hd', 'dense')}, {_hits_sql('hs', 'sparse')},
md AS (SELECT 'dense_only' AS mode, * FROM ({_expected_sql('hd')}) UNION ALL SELECT 'sparse_only', * FROM ({_expected_sql('hs')})),
mr AS (SELECT *, CASE WHEN case_id % 13 = 0 THEN 'timeout' END AS error, case_id % 40 + 10 AS latency FROM md)"""


@query(f"""WITH {_MODES} SELECT mode, count(*) AS cases, count(error) AS errors,
{', '.join(f"round(sum(CASE WHEN error IS NULL THEN {x} ELSE 0 END) / count(*), 6) AS {n}" for n, x in (
    ('hit5', 'coalesce((first_rank <= 5)::INT, 0)'), ('hit10', 'coalesce((first_rank <= 10)::INT, 0)'), ('recall5', '(CASE WHEN first_rank <= 5 THEN recall ELSE 0 END)'), ('recall10', 'recall'), ('mrr', 'mrr'), ('latency_ms', 'latency')))}
FROM mr GROUP BY mode""")
def mode_ablation(spark, d):
    def one(mode: str, found: DataFrame) -> DataFrame:
        rows = S.expected_sources(expectations(spark, d), hits(spark, d, found))
        hit = lambda k: F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))
        c = F.col("case_id")
        return rows.select(
            F.lit(mode).alias("mode"), F.when(c % 13 == 0, "timeout").alias("error"), hit(5).alias("hit5"), hit(10).alias("hit10"),
            F.when(F.col("first_rank") <= 5, F.col("recall")).otherwise(0.0).alias("recall5"), F.col("recall").alias("recall10"), "mrr", (c % 40 + 10).alias("latency_ms"),
        )

    return S.mode_ablation(one("dense_only", R.dense(spark, d)).unionByName(one("sparse_only", R.sparse(spark, d))))


_THREE = f"""{_RANKED.replace(R.SPARSE, R.FUSED.replace(R.CHUNKS + ",", "chunks0 AS (SELECT doc_id AS id, source, 0 AS page, 0 AS chunk_index, text FROM documents),").replace("JOIN chunks USING", "JOIN chunks0 USING").replace("hits AS MATERIALIZED", "hits0 AS MATERIALIZED"))},
{_hits_sql('fh', 'fused')}, {_hits_sql('dh', 'dense')},
fs3 AS (SELECT g.case_id, coalesce(bool_or(h.paper_id = g.paper_id), false) AS paper, coalesce(bool_or(h.paper_id = g.paper_id AND g.page BETWEEN h.page_start AND h.page_end), false) AS page,
  coalesce(bool_or(contains({_NORM.format('h.text')}, {_NORM.format('g.gold')})), false) AS span FROM gp g LEFT JOIN fh h USING (case_id) GROUP BY 1),
ds3 AS (SELECT g.case_id, coalesce(bool_or(contains({_NORM.format('h.text')}, {_NORM.format('g.gold')})), false) AS dense_span FROM gp g LEFT JOIN dh h USING (case_id) GROUP BY 1),
three AS (SELECT case_id, paper, page, span, dense_span, span_rank IS NOT NULL AS other_span FROM fs3 JOIN ds3 USING (case_id) JOIN rk USING (case_id))"""


def three(spark, d) -> DataFrame:
    """Whether the fused hits reach a case's paper, page and span, and the dense and the lexical hits its span."""
    g = gold_papers(spark, d)
    dense, sparse = written(R.dense(spark, d), "dense"), written(R.sparse(spark, d), "sparse")
    fused = hits(spark, d, R.R.rrf(dense, sparse))
    there = lambda c: F.col(c).isNotNull()
    rows = S.page_hits(g, fused).join(S.span_hits(g, fused), "case_id").select("case_id", there("paper_rank").alias("paper"), there("page_rank").alias("page"), there("span_rank").alias("span"))
    for name, found in (("dense_span", dense), ("other_span", sparse)):
        rows = rows.join(S.span_hits(g, hits(spark, d, found)).select("case_id", there("span_rank").alias(name)), "case_id")
    return rows


@query(f"""WITH {_THREE} SELECT case_id, CASE WHEN NOT dense_span AND span THEN 'A_dense_miss_hybrid_rescue' WHEN span AND NOT other_span THEN 'B_fixed_hit_section_miss'
WHEN other_span AND NOT span THEN 'C_section_hit_fixed_miss' WHEN paper AND NOT page THEN 'D_paper_hit_wrong_page' WHEN NOT paper THEN 'E_paper_page_miss'
WHEN page AND NOT span THEN 'F_page_hit_but_span_miss' ELSE 'OK_span_hit' END AS category FROM three""")
def failure_modes(spark, d):
    return three(spark, d).select("case_id", S.failure_mode().alias("category"))


@query(f"""WITH {_THREE} SELECT case_id, concat_ws('+', CASE WHEN NOT dense_span AND NOT other_span THEN 'GOLD_SPAN_NOT_IN_TOP25' END,
CASE WHEN dense_span AND NOT span THEN 'RRF_RANKING_LOSS' END, CASE WHEN NOT dense_span AND other_span AND span THEN 'SPARSE_RESCUED' END) AS cause FROM three""")
def miss_causes(spark, d):
    return three(spark, d).select("case_id", M.miss_cause("dense_span", "other_span", "span").alias("cause"))


_GATE_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value, {t}::DOUBLE AS threshold, '{op}' AS op, {m} {op} {t} AS passed FROM gm" for m, t, op in M.GATE)


@query(f"""WITH {_RANKED}, {E.BEHAVIOUR}, {E.METRICS}, gm AS (SELECT bm.*, r.recall10, r.page_hit10, r.span_hit10 FROM bm, ({_METRICS}) r),
gr AS ({_GATE_ROWS}) SELECT *, CASE WHEN (SELECT bool_and(passed) FROM gr) THEN 'FINAL_ACCEPT' WHEN (SELECT bool_and(passed OR metric IN ('citation_support', 'unsupported_claim')) FROM gr)
THEN 'FINAL_ACCEPT_WITH_LIMITATIONS' ELSE 'FINAL_NOT_ACCEPTED' END AS verdict FROM gr""")
def release_gate(spark, d):
    r = S.retrieval_metrics(ranks(spark, d)).select("recall10", "page_hit10", "span_hit10")
    return M.gate(M.behaviour(E.behaviours(spark, d)).crossJoin(r))


@query("SELECT item_id AS case_id FROM benchmark ORDER BY item_id LIMIT 25")
def first_cases(spark, d):
    """A run over the first cases only: the limit is the feature."""
    return S.first_cases(cases(spark, d), 25).select("case_id")
