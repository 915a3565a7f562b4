"""Queries over pages, headings, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as K

from . import adapters as A

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_COLLAPSE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_CLEANED = f"""
cl AS (SELECT paper_id, source, page, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format("x")}),
       lambda x: x <> '' AND NOT regexp_full_match(x, '\\d{{1,4}}')), chr(10)) AS text FROM pages_in)
"""
_RUNNING = """
tot AS (SELECT paper_id, greatest(3, floor(count(*) * 0.6 + 0.999))::BIGINT AS threshold FROM cl GROUP BY paper_id),
cnt AS (SELECT paper_id, line, count(*) AS n_on FROM (SELECT DISTINCT paper_id, page, unnest(string_split(text, chr(10))) AS line FROM cl) GROUP BY 1, 2),
run_lines AS (SELECT paper_id, line, n_on, threshold FROM cnt JOIN tot USING (paper_id) WHERE n_on >= threshold AND length(line) < 120)
"""


@query(f"WITH {A.PLAIN_PAGES_SQL}, {_CLEANED} SELECT paper_id, page, text, length(text) AS n_chars FROM cl WHERE length({_COLLAPSE.format('text')}) >= 50")
def page_clean_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = A.plain_pages(spark, d).select("paper_id", "page", K.clean_page(F.col("text")).alias("text"))
    return rows.withColumn("n_chars", F.length("text")).filter(F.length(T.collapsed(F.col("text"))) >= 50)


@query(f"""
WITH p AS (SELECT 'd' || doc_id AS paper_id, source, 1 AS page, text FROM documents WHERE length(text) > 0),
w AS (SELECT paper_id, source, page, unnest(range(0, length(text), {K.CHUNK_SIZE - K.OVERLAP})) AS s, text FROM p),
c AS (SELECT paper_id, source, page, s, {_STRIP.format(f"substr(text, s::BIGINT + 1, {K.CHUNK_SIZE})")} AS text FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY s) - 1 AS chunk_index FROM c WHERE text <> '')
SELECT paper_id || '_p' || page || '_c' || chunk_index AS chunk_id, paper_id, source, page, chunk_index, text FROM n
""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    pages = A.read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), "source", F.lit(1).alias("page"), "text")
    return K.cut_fixed(pages)


@query(f"WITH {A.HEADED_PAGES_SQL}, {_CLEANED}, {_RUNNING} SELECT * FROM run_lines")
def header_footer_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.running_lines(A.headed_pages(spark, d))


def _sql_pattern(p: str) -> str:
    return A.q(p.replace(r"\x{4e00}-\x{9fff}", r"\x{4e00}-\x{9fff}"))


_ALIASES = "ali AS (SELECT unnest({0}) AS alias, unnest({1}) AS section)".format(
    A.sql_list([a for s, names in K.SECTION_ALIASES.items() for a in names]), A.sql_list([s for s, names in K.SECTION_ALIASES.items() for _ in names])
)
_EDGE = A.q(K._EDGE)


def _canon(x: str) -> str:
    return f"(SELECT any_value(section) FROM ali WHERE alias = {_COLLAPSE.format(f'regexp_replace(lower({x}), {_EDGE}, {A.q(chr(0))[:0]}' + A.q('') + ", 'g')")})"


_BARRED = " AND ".join(f"NOT regexp_matches(title, {_sql_pattern(p)})" for p in K.BARRED_TITLE_PATTERNS.values())
#: From lines_in(paper_id, page, pos, line): hd with the heading judged with and without numbers.
_HEADING = f"""
{_ALIASES},
h1 AS (SELECT *, {_STRIP.format("line")} AS bare FROM lines_in),
h2 AS (SELECT *, {_COLLAPSE.format(f"regexp_replace(lower(bare), {_EDGE}, '', 'g')")} AS norm, {_STRIP.format(f"regexp_extract(bare, {_sql_pattern(K.NUMBERED)}, 2)")} AS title FROM h1),
h3 AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '\\s+', ' ', 'g'), {_EDGE}, '', 'g')) AS generic, {_COLLAPSE.format(f"regexp_replace(lower(title), {_EDGE}, '', 'g')")} AS tnorm,
       title <> '' AND length(title) BETWEEN 3 AND 50 AND len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 6 AND {_BARRED} AS ok FROM h2),
hd AS (SELECT h3.* EXCLUDE (norm, tnorm), a.section AS plain,
       coalesce(a.section, CASE WHEN ok THEN coalesce(b.section, CASE WHEN len(string_split(generic, ' ')) >= 2 THEN substr(generic, 1, 80) END) END) AS label
       FROM h3 LEFT JOIN ali a ON a.alias = norm LEFT JOIN ali b ON b.alias = tnorm)
"""
_CLEAN_LINES = """
kept AS (SELECT paper_id, page, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(g.gone, []), x)) AS ls
         FROM cl LEFT JOIN (SELECT paper_id, list(line) AS gone FROM run_lines GROUP BY 1) g USING (paper_id)),
kept2 AS (SELECT paper_id, page, CASE WHEN len(ls) = 0 THEN [''] ELSE ls END AS ls FROM kept),
lines_in AS (SELECT paper_id, page, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM kept2)
"""
_RUNS = """
m1 AS (SELECT *, coalesce(bool_or(coalesce(label = 'references', false)) OVER (PARTITION BY paper_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inref FROM hd),
m2 AS (SELECT *, CASE WHEN inref THEN plain ELSE label END AS h FROM m1),
m3 AS (SELECT *, count(h) OVER o AS seg, coalesce(last_value(h IGNORE NULLS) OVER o, 'front_matter') AS section FROM m2
       WINDOW o AS (PARTITION BY paper_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pc AS (SELECT paper_id, page, seg, section, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS text FROM m3 WHERE h IS NULL GROUP BY 1, 2, 3, 4),
pn AS (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY paper_id ORDER BY page, pos) THEN 1 ELSE 0 END AS new FROM pc),
pr AS (SELECT *, sum(new) OVER (PARTITION BY paper_id ORDER BY page, pos)::BIGINT AS run FROM pn)
"""
_SECTIONS = f"{A.HEADED_PAGES_SQL}, {_CLEANED}, {_RUNNING}, {_CLEAN_LINES}, {_HEADING}, {_RUNS}"


@query(f"WITH {A.HEADED_PAGES_SQL}, {_CLEANED}, lines_in AS (SELECT paper_id, page, unnest(string_split(text, chr(10))) AS line FROM cl), {_HEADING} SELECT label, count(*) AS n, count(DISTINCT paper_id) AS n_papers FROM hd WHERE label IS NOT NULL GROUP BY label")
def heading_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = A.headed_pages(spark, d).select("paper_id", F.explode(F.split(K.clean_page(F.col("text")), "\n")).alias("line"))
    return K.with_headings(rows).select("paper_id", F.col("full").alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("n_papers"))


_REFUSED = " ".join(f"WHEN regexp_matches(title, {_sql_pattern(p)}) THEN {A.q(reason)}" for reason, p in K.BARRED_TITLE_PATTERNS.items())


@query(f"""WITH {A.LINES_SQL}, t AS (SELECT doc_id, i, substr(regexp_replace(line, '[^\\x00-\\x7F]', 'x', 'g'), 1, 20 + (i % 40)) AS title FROM lines WHERE line <> ''),
r AS (SELECT CASE WHEN length(title) NOT BETWEEN 3 AND 50 THEN 'length' WHEN len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')) NOT BETWEEN 1 AND 6 THEN 'words' {_REFUSED} END AS reason FROM t)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def heading_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Why the beginnings of all lines, in ASCII, would be no numbered headings."""
    plain = F.regexp_replace("line", r"[^\x00-\x7F]", "x")
    rows = A.lines(spark, d).filter("line <> ''").select(F.substring(plain, F.lit(1), 20 + F.col("i") % 40).alias("title"))
    return rows.groupBy(K.title_problem(F.col("title")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_SECTIONS} SELECT paper_id, run, section, count(*) AS n_pieces, min(page) AS page_start, max(page) AS page_end, string_agg(text, chr(10) ORDER BY page, pos) AS text FROM pr GROUP BY 1, 2, 3")
def section_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = K.section_runs(K.clean_lines(A.headed_pages(spark, d)))
    pages = F.col("pieces.page")
    return runs.select("paper_id", "run", "section", F.size("pieces").alias("n_pieces"), F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.array_join("pieces.text", "\n").alias("text"))


_STEP = K.CHUNK_SIZE - K.OVERLAP
_CHUNKS = f"""
{_SECTIONS},
fronts AS (SELECT paper_id, bool_and(section = 'front_matter') AS plain FROM pr GROUP BY 1),
fb AS (SELECT paper_id, 1::BIGINT AS run, 'body' AS section, page, 0 AS pos, string_agg(line, chr(10) ORDER BY pos) AS text, 'fallback_fixed' AS chunking_mode
       FROM lines_in JOIN fronts USING (paper_id) WHERE plain GROUP BY paper_id, page),
al AS (SELECT paper_id, run, section, page, pos, text, 'section_aware' AS chunking_mode FROM pr JOIN fronts USING (paper_id) WHERE NOT plain UNION ALL BY NAME SELECT * FROM fb),
ps AS (SELECT * EXCLUDE (text), {_STRIP.format("text")} AS text FROM al),
pk AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY paper_id, run ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg FROM ps WHERE text <> ''),
rn AS (SELECT paper_id, run, section, chunking_mode, string_agg(text, chr(10) ORDER BY page, pos) AS whole, list({{'beg': beg, 'page': page}} ORDER BY page, pos) AS begins FROM pk GROUP BY 1, 2, 3, 4),
rs AS (SELECT *, unnest(range(0, CASE WHEN length(whole) > {K.CHUNK_SIZE} THEN ceil((length(whole) - {K.CHUNK_SIZE}) / {_STEP}.0)::BIGINT + 1 ELSE 1 END)) * {_STEP} AS s FROM rn),
ck AS (SELECT paper_id, run, section, chunking_mode, s, {_STRIP.format(f"substr(whole, s + 1, {K.CHUNK_SIZE})")} AS text,
       list_filter(begins, lambda b: b.beg <= s)[-1].page AS page_start, list_filter(begins, lambda b: b.beg <= least(s + {K.CHUNK_SIZE}, length(whole)) - 1)[-1].page AS page_end FROM rs),
cn AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY run, s) - 1 AS chunk_index,
       regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS sl FROM ck WHERE length(text) >= {K.MIN_CHUNK}),
chunks AS (SELECT paper_id || '__' || CASE WHEN sl = '' THEN 'sec' ELSE sl END || '__p' || page_start || '-' || page_end || '__i' || chunk_index AS chunk_id,
       paper_id, section, page_start, page_end, chunk_index, text, chunking_mode FROM cn)
"""


@query(f"WITH {_CHUNKS} SELECT * FROM chunks")
def chunk_section_aware(spark: SparkSession, d: str) -> DataFrame:
    return K.build_chunks(A.headed_pages(spark, d))


@query(f"WITH {_CHUNKS} SELECT section, lower(trim(section)) NOT IN ('references', 'acknowledgments') AS indexable, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY 1, 2")
def chunk_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rows = K.build_chunks(A.headed_pages(spark, d)).withColumn("indexable", K.indexable(F.col("section")))
    return rows.groupBy("section", "indexable").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {_CHUNKS}, ct AS (SELECT paper_id, sum(length(text)) AS clean_chars FROM cl GROUP BY 1),
ch AS (SELECT paper_id, count(*) AS n_chunks, count(DISTINCT section) AS n_sections, sum(length(text)) AS chunk_chars, bool_or(chunking_mode = 'fallback_fixed') AS fallback FROM chunks GROUP BY 1)
SELECT paper_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_sections, 0) AS n_sections, clean_chars::BIGINT AS clean_chars, coalesce(chunk_chars, 0)::BIGINT AS chunk_chars, coalesce(fallback, false) AS fallback,
round(coalesce(chunk_chars, 0) / greatest(clean_chars, 1), 6) AS coverage, coalesce(chunk_chars, 0) / greatest(clean_chars, 1) < 0.5 AS low_coverage FROM ct LEFT JOIN ch USING (paper_id)""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    pages = A.headed_pages(spark, d)
    clean = pages.groupBy("paper_id").agg(F.sum(F.length(K.clean_page(F.col("text")))).alias("clean_chars"))
    found = K.build_chunks(pages).groupBy("paper_id").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("section").alias("n_sections"), F.sum(F.length("text")).alias("chunk_chars"), F.bool_or(F.col("chunking_mode") == "fallback_fixed").alias("fallback")
    )
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("n_chunks", "n_sections", "chunk_chars")}
    rows = clean.join(found, "paper_id", "left").withColumns(zero | {"fallback": F.coalesce("fallback", F.lit(False))})
    ratio = F.col("chunk_chars") / F.greatest("clean_chars", F.lit(1))
    return rows.withColumns({"coverage": F.round(ratio, 6), "low_coverage": ratio < 0.5})


_META = [(f"src{i}.pdf", f"src{i}", f"Title {i}", f"10.1/{i}" if i % 3 else None) for i in range(0, 20, 2)] + [("d3.pdf", "d3", "By paper", "10.9/3")]
_META_SCHEMA = "final_file string, stem string, title string, doi string"


@query(f"""WITH {A.values_sql("man", _META, _META_SCHEMA)}, keys AS (SELECT unnest([final_file, stem]) AS key, title, doi FROM man),
p AS (SELECT 'd' || doc_id AS paper_id, source, text FROM documents)
SELECT p.paper_id, p.source, coalesce(CASE WHEN a.key IS NOT NULL THEN a.title ELSE b.title END, '') AS title, coalesce(CASE WHEN a.key IS NOT NULL THEN a.doi ELSE b.doi END, '') AS doi,
'unknown' AS section, 1 AS page_start, 1 AS page_end, 'fixed' AS chunking_mode FROM p LEFT JOIN keys a ON a.key = p.paper_id LEFT JOIN keys b ON b.key = p.source""")
def meta_enrich(spark: SparkSession, d: str) -> DataFrame:
    keys = A.values(spark, _META, _META_SCHEMA).select(F.explode(F.array("final_file", "stem")).alias("key"), "title", "doi")
    docs = A.read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), "source", F.lit(1).alias("page"))
    return K.enriched(docs, F.broadcast(keys), "fixed").select("paper_id", "source", "title", "doi", "section", "page_start", "page_end", "chunking_mode")
