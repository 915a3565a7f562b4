"""Queries over dense and lexical search, fusion, diversification and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import indexes as I
from lectern.operators import retrieval as R
from lectern.sources.places import fresh_place

from . import adapters as A
from .registry import registry

QUERIES, ORACLES, query = registry()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), "source", (F.col("doc_id") % 7 + 1).alias("page"), (F.col("doc_id") % 10).alias("chunk_index"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def dense_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return vectors(spark, d).filter("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("query_id"), "vector")


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def dense(spark, d, k=R.DENSE_K):
    return R.dense_search(dense_queries(spark, d), vectors(spark, d), k)


def sparse(spark, d):
    return R.text_search(text_queries(spark, d), chunks(spark, d))


def hits(spark, d):
    """Fused hits with distance, source, page, chunk_index and text."""
    return R.resolved(R.inherit_distance(R.rrf(dense(spark, d), sparse(spark, d))), chunks(spark, d))


CHUNKS = "chunks AS (SELECT doc_id AS id, source, doc_id % 7 + 1 AS page, doc_id % 10 AS chunk_index, text FROM documents)"
DENSE = f"""
dq AS (SELECT vec_id // 20 AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
dd AS (SELECT query_id, vec_id AS id, round(list_sum(list_transform(range(1, len(qv) + 1), lambda i: (qv[i]::DOUBLE - embedding[i]::DOUBLE) * (qv[i]::DOUBLE - embedding[i]::DOUBLE))), 9) AS distance FROM dq, embeddings),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM dd),
dense AS MATERIALIZED (SELECT * FROM dr WHERE rank < {R.DENSE_K})
"""
_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 2)"
INDEX = f"""
ti AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents),
tx AS (SELECT id, len(ts) AS n, unnest(ts) AS token FROM ti),
idx AS (SELECT token, id, count(*) / n AS weight FROM tx GROUP BY token, id, n)
"""
SPARSE = f"""
{INDEX},
qi AS (SELECT item_id AS query_id, {_TOKENS} AS ts FROM benchmark),
qx AS (SELECT query_id, len(ts) AS n, unnest(ts) AS token FROM qi),
qw AS (SELECT token, query_id, count(*) / n AS qw FROM qx GROUP BY token, query_id, n),
ss AS (SELECT query_id, id, round(sum(weight * qw), 9) AS sparse_score FROM idx JOIN qw USING (token) GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id) - 1 AS rank FROM ss WHERE sparse_score > 0),
sparse AS MATERIALIZED (SELECT * FROM sr WHERE rank < {R.SPARSE_K})
"""
FUSED = f"""
{DENSE}, {SPARSE},
fj AS (SELECT query_id, id, d.distance, d.rank AS dense_rank, s.sparse_score, s.rank AS sparse_rank FROM dense d FULL JOIN sparse s USING (query_id, id)),
fs AS (SELECT *, round(coalesce(1 / (dense_rank + {R.RRF_K + 1}), 0) + coalesce(1 / (sparse_rank + {R.RRF_K + 1}), 0), 12) AS rrf_score FROM fj),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) - 1 AS rank FROM fs),
fused AS (SELECT * FROM fr WHERE rank < {R.FUSION_K}),
inherited AS MATERIALIZED (SELECT * REPLACE (coalesce(distance, min(distance) OVER (PARTITION BY query_id)) AS distance) FROM fused),
{CHUNKS},
hits AS MATERIALIZED (SELECT i.*, source, page, chunk_index, text FROM inherited i JOIN chunks USING (id))
"""
_FOLD = r"replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')"
_GRAMS = "CASE WHEN length(s) > 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) WHEN length(s) > 0 THEN [s] ELSE [] END"
DIVERSE = f"""
{FUSED},
hn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM hits),
hg AS MATERIALIZED (SELECT query_id, id, source, chunk_index, {_GRAMS} AS g FROM (SELECT *, {_FOLD} AS s FROM hn)),
dup AS (SELECT a.query_id, a.id AS a, b.id AS b FROM hg a JOIN hg b ON a.query_id = b.query_id AND a.id <> b.id AND a.source = b.source AND abs(a.chunk_index - b.chunk_index) <= 1
        WHERE len(list_intersect(a.g, b.g)) / greatest(len(list_distinct(list_concat(a.g, b.g))), 1) >= 0.9),
dl AS MATERIALIZED (SELECT query_id, a, list(b) AS bs FROM dup GROUP BY 1, 2),
hh AS MATERIALIZED (SELECT hn.query_id, hn.pos, hn.id, hn.source, coalesce(bs, []) AS bs FROM hn LEFT JOIN dl ON dl.query_id = hn.query_id AND dl.a = hn.id),
st AS (SELECT query_id, 0::BIGINT AS pos, []::BIGINT[] AS sel, []::VARCHAR[] AS src FROM (SELECT DISTINCT query_id FROM hn)
       UNION ALL
       SELECT st.query_id, h.pos, CASE WHEN ok THEN list_append(sel, h.id) ELSE sel END, CASE WHEN ok THEN list_append(src, h.source) ELSE src END
       FROM st JOIN hh h ON h.query_id = st.query_id AND h.pos = st.pos + 1,
       LATERAL (SELECT len(sel) < {R.TOP_K} AND len(list_filter(src, lambda x: x = h.source)) < {R.MAX_PER_SOURCE} AND NOT list_has_any(sel, h.bs) AS ok)),
fin AS (SELECT query_id, sel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS r FROM st) WHERE r = 1),
diverse AS MATERIALIZED (SELECT query_id, unnest(range(len(sel))) AS rank, unnest(sel) AS id FROM fin)
"""
_EST = "greatest(1, ceil((length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 4 + length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')) / 1.5))::BIGINT"
_BLOCK = "'source=' || source || ' page=' || page || ' chunk=' || chunk_index || chr(10) || text"
BUDGETED = f"""
{DIVERSE},
bt AS MATERIALIZED (SELECT d.*, source, page, chunk_index, text, {_EST.format(f"({_BLOCK})")} AS n_tokens FROM diverse d JOIN chunks USING (id)),
bs AS (SELECT query_id, -1::BIGINT AS pos, 0::BIGINT AS used, []::BIGINT[] AS sel FROM (SELECT DISTINCT query_id FROM bt)
       UNION ALL
       SELECT bs.query_id, b.rank, CASE WHEN len(sel) = 0 OR used + n_tokens <= {R.TOKEN_BUDGET} THEN used + n_tokens ELSE used END,
              CASE WHEN len(sel) = 0 OR used + n_tokens <= {R.TOKEN_BUDGET} THEN list_append(sel, b.id) ELSE sel END
       FROM bs JOIN bt b ON b.query_id = bs.query_id AND b.rank = bs.pos + 1),
bf AS (SELECT query_id, sel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) AS r FROM bs) WHERE r = 1),
bo AS (SELECT query_id, unnest(range(len(sel))) AS rank, unnest(sel) AS id FROM bf),
budgeted AS (SELECT bo.*, n_tokens FROM bo JOIN (SELECT query_id, id, n_tokens FROM bt) USING (query_id, id))
"""

#: What is put before each turn, as the supplied texts name no topic of the expansions.
_QUESTIONS = (
    "What does PMS activation do with  Ozone?", "高级氧化 对 PFAS 的去除", "芬顿", "nothing to expand here", "AOP pfos photocatalysis STRASSE Straße", " 新污染物\t过硫酸 ",
)
_ASKED_SQL = f"v AS (SELECT conv_id, turn, {A.sql_list(_QUESTIONS)}[(conv_id + turn) % {len(_QUESTIONS)} + 1] || ' ' || text AS question FROM conversations)"


def _expand_sql() -> str:
    parts = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(lower(question), {A.q(w)})" for w in words) + f" THEN {A.q(text)} END" for words, text in R.EXPANSIONS
    )
    return f"concat_ws(chr(10), question, {parts})"


@query(f"WITH {_ASKED_SQL} SELECT conv_id, turn, {_expand_sql()} AS expanded, replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), 'ß', 'ss') AS cache_key FROM v")
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "conversations")
    topic = F.element_at(F.array(*map(F.lit, _QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % len(_QUESTIONS) + 1).cast("int"))
    q = rows.select("conv_id", "turn", F.concat(topic, F.lit(" "), "text").alias("question"))
    return q.select("conv_id", "turn", R.expanded(F.col("question")).alias("expanded"), R.cache_key(F.col("question")).alias("cache_key"))


@query(f"WITH {DENSE} SELECT query_id, id, distance, rank FROM dense")
def dense_knn(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d)


@query(f"WITH {INDEX} SELECT token, id, round(weight, 9) AS weight FROM idx")
def sparse_index_build(spark: SparkSession, d: str) -> DataFrame:
    return R.sparse_index(chunks(spark, d)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {SPARSE} SELECT query_id, id, sparse_score, rank FROM sparse")
def sparse_search(spark: SparkSession, d: str) -> DataFrame:
    return sparse(spark, d)


@query(f"WITH {DENSE} SELECT query_id, id, distance, rank FROM dense")
def dense_saved(spark: SparkSession, d: str) -> DataFrame:
    """The same hits from a saved collection: vectors in cells around pivots, of which a query reads what it can't exclude."""
    path = fresh_place(spark, "vectors")
    I.save_vectors(vectors(spark, d), path)
    return I.saved_search(dense_queries(spark, d), path)[0]


@query(f"WITH {SPARSE} SELECT query_id, id, sparse_score, rank FROM sparse")
def sparse_saved(spark: SparkSession, d: str) -> DataFrame:
    """The same hits from saved posting blocks, of which a query reads those that can reach its k-th score."""
    path = fresh_place(spark, "postings")
    I.save_texts(chunks(spark, d), path)
    return I.block_search(R.weights(text_queries(spark, d), "query_id"), spark.read.parquet(path))[0]


@query(f"WITH {FUSED} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf(dense(spark, d), sparse(spark, d))


@query(f"WITH {FUSED} SELECT query_id, id, distance, rank FROM inherited")
def inherit_distance(spark: SparkSession, d: str) -> DataFrame:
    return R.inherit_distance(R.rrf(dense(spark, d), sparse(spark, d))).select("query_id", "id", "distance", "rank")


@query(f"WITH {FUSED} SELECT query_id, id, rank, source, page, chunk_index, length(text) AS n_chars FROM hits")
def resolve_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("query_id", "id", "rank", "source", "page", "chunk_index", F.length("text").alias("n_chars"))


@query(f"WITH RECURSIVE {DIVERSE} SELECT query_id, rank, id FROM diverse")
def diversify_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.diversify(hits(spark, d)).select("query_id", "rank", "id")


@query(f"WITH RECURSIVE {BUDGETED} SELECT query_id, rank, id, n_tokens FROM budgeted")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return R.within_budget(R.diversify(hits(spark, d))).select("query_id", "rank", "id", "n_tokens")


@query(f"""WITH RECURSIVE {BUDGETED}, blk AS (SELECT query_id, rank, '[S' || (rank + 1) || '] ' || {_BLOCK} || chr(10) || '[/S' || (rank + 1) || ']' AS block FROM budgeted JOIN chunks USING (id))
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blk GROUP BY 1""")
def context_format(spark: SparkSession, d: str) -> DataFrame:
    return R.formatted(R.within_budget(R.diversify(hits(spark, d))))


@query(f"WITH RECURSIVE {BUDGETED} SELECT b.query_id, b.rank, b.id, h.source, h.distance, h.rrf_score, b.n_tokens FROM budgeted b JOIN hits h USING (query_id, id)")
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the stated queries through the whole pipeline, from both searches to what fits the budget."""
    asked = dense_queries(spark, d).join(text_queries(spark, d), "query_id", "full_outer")
    found = R.retrieve(asked, vectors(spark, d), chunks(spark, d))
    return found.select("query_id", "rank", "id", "source", "distance", "rrf_score", "n_tokens")


@query(f"""WITH g AS (SELECT doc_id, source, {_GRAMS} AS g FROM (SELECT *, {_FOLD} AS s FROM documents)),
n AS (SELECT *, lag(g) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM g)
SELECT doc_id, len(g) AS n_shingles, round(len(list_intersect(g, p)) / greatest(len(list_distinct(list_concat(g, p))), 1), 6) AS similarity FROM n WHERE p IS NOT NULL""")
def shingle_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the one before it in its source: ids are paired first, and grams then joined to the pairs."""
    from pyspark.sql import Window

    docs = A.read(spark, d, "documents").select("doc_id", "source", "text")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select("doc_id", before.alias("previous")).filter("previous is not null")
    grams = docs.select("doc_id", T.shingles(F.col("text")).alias("g"))
    rows = pairs.join(grams, "doc_id").join(grams.select(F.col("doc_id").alias("previous"), F.col("g").alias("p")), "previous")
    return rows.select("doc_id", F.size("g").alias("n_shingles"), F.round(T.jaccard(F.col("g"), F.col("p"), 1.0), 6).alias("similarity"))


@query(f"SELECT doc_id, {_EST.format('text')} AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("n_tokens"))


@query(f"""WITH {FUSED}, ov AS (SELECT h.query_id, h.id, h.rank AS input_rank, len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) AS rerank_score
FROM hits h JOIN qi q USING (query_id) JOIN ti t ON t.id = h.id), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, input_rank) - 1 AS rank FROM ov)
SELECT * FROM rr WHERE rank < 8""")
def rerank_stub(spark: SparkSession, d: str) -> DataFrame:
    """The reranker's place in the plan, with shared tokens as the scorer."""
    asked = text_queries(spark, d).select("query_id", F.col("text").alias("question"))
    rows = hits(spark, d).join(asked, "query_id")
    shared = F.size(F.array_intersect(R.tokens(F.col("question")), R.tokens(F.col("text"))))
    return R.reranked(rows, shared, 8).select("query_id", "id", "input_rank", "rerank_score", "rank")


@query(f"""WITH {DENSE.replace(f"rank < {R.DENSE_K}", "rank < 20")} SELECT query_id, id, distance, rank FROM dense""")
def topk_pinned_ties(spark: SparkSession, d: str) -> DataFrame:
    """Over-fetching of the dense-only mode: max(4 k, 20) with ties by id."""
    return dense(spark, d, max(4 * R.TOP_K, 20))


@query(f"""WITH RECURSIVE {DENSE}, {SPARSE}, fj AS (SELECT query_id, id, d.distance, d.rank AS dense_rank, s.rank AS sparse_rank FROM dense d FULL JOIN sparse s USING (query_id, id)),
fs AS (SELECT *, round(coalesce(1 / (dense_rank + {R.RRF_K + 1}), 0) + coalesce(1 / (sparse_rank + {R.RRF_K + 1}), 0), 12) AS rrf_score FROM fj),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) - 1 AS rank FROM fs),
{CHUNKS}, pool AS (SELECT fr.query_id, fr.id, fr.rank, source, chunk_index, len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) AS overlap
  FROM fr JOIN chunks USING (id) JOIN qi q USING (query_id) JOIN ti t ON t.id = fr.id WHERE fr.rank < {R.FUSION_K}),
counts AS (SELECT query_id, count(*) AS n, max(overlap) AS best FROM pool GROUP BY 1)
SELECT query_id, n, best FROM counts""")
def reranker_pool(spark: SparkSession, d: str) -> DataFrame:
    """What mode hybrid_reranker orders: the fused pool of each query with a text, and its best score."""
    asked = text_queries(spark, d).select("query_id", F.col("text").alias("question"))
    rows = R.resolved(R.rrf(dense(spark, d), sparse(spark, d)), chunks(spark, d)).join(asked, "query_id")
    shared = F.size(F.array_intersect(R.tokens(F.col("question")), R.tokens(F.col("text"))))
    return R.reranked(rows, shared, R.FUSION_K).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rerank_score").alias("best"))
